from pyspark.sql import functions as F

from loomspark.functions import text, values


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_cleaning_order(spark):
    assert one(spark, "<b>Hi</b> http://x.y ＡＢ, now!\n\n ok", text.clean) == "hi ab now ok"
    assert one(spark, None, text.clean) is None
    assert one(spark, "a.b@c.de +49 170 1234567 é-x 😀", lambda c: text.clean(c, strip_email=True, strip_phone=True, remove_emoji=True, remove_special_chars=True)) == "é-x"


def test_normalize(spark):
    assert one(spark, "關聯數據 2024-05-01 12:30", lambda c: text.normalize(c, simplify=True, times=True)) == "关联数据 TIME_TOKEN TIME_TOKEN"
    assert one(spark, "2024-05-01", lambda c: text.normalize(c, numbers=True, times=True)) == "NUM_TOKEN - NUM_TOKEN - NUM_TOKEN"
    assert one(spark, "abc", lambda c: text.normalize(c, rules=[("(a)(b)", r"\2\1"), ("c", "$d")])) == "ba $d"
    assert one(spark, "abc", lambda c: text.normalize(c, rules=[("z", "q"), ("b", "B"), ("c", "C")], first_match=True)) == "a B c"


def test_tokens_phrases_ngrams(spark):
    assert one(spark, "supply chain of rareEarth re-use", lambda c: text.tokenize(c, [("Supply Chain", "")])) == ["Supply_Chain", "of", "rare", "earth", "re", "use"]
    assert one(spark, "a/b-c", lambda c: text.tokenize(c, hyphens=False)) == ["a/b-c"]
    tokens = one(spark, "rare earth recovery rare earth", lambda c: text.ngrams(text.tokenize(c), 2, 3))
    assert tokens == ["rare", "earth", "recovery", "rare", "earth", "rare_earth", "earth_recovery", "recovery_rare", "rare_earth_recovery", "earth_recovery_rare", "recovery_rare_earth"]
    assert one(spark, "", lambda c: text.ngrams(text.tokenize(c), 2, 3)) == []


def test_keyword_and_variants(spark):
    assert one(spark, " -Rare_Earth! ", text.keyword) == "rare earth"
    assert [one(spark, x, text.keyword) for x in ("12", "x", "-_/", "")] == [None] * 4
    assert set(one(spark, "Rare earth", text.focus_variants)) == {"rare earth", "rare_earth", "rareearth", "rare", "earth"}


def test_years(spark):
    for value, year in (("2024-05-01", 2024), ("2023", 2023), ("2022.0", 2022), ("x", None), (None, None), ("2021/3/4", 2021)):
        assert one(spark, value, values.year_of) == year
    assert [one(spark, "2021", lambda c, g=g: values.year_bucket(c, g)) for g in ("year", "5_year", "decade")] == ["2021", "2021-2025", "2020s"]
    assert one(spark, "2025", lambda c: values.year_bucket(c, "5_year")) == "2021-2025"
    assert one(spark, "2024.5", values.year_bucket) is None
