"""Schemas of the corpus and of result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
TOKENS = T.ArrayType(S)


def fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


CORPUS = fields(
    doc_id=S, id=S, source_profile=S, title=S, raw_text=S, year=I, source=S, author=S, institution=S, country_or_region=S,
    category_or_tag=S, keyword_field=S, extra_metadata=T.MapType(S, S), clean_text=S, normalized_text=S, tokens=TOKENS,
    phrase_hits=TOKENS, filtered_tokens=TOKENS, status=S, raw_hash=S, row_order=L,
)
DICTIONARY = fields(id=S, kind=S, collection=S, table_id=S, source=S, target=S, enabled=B, hits=L, tags=TOKENS, notes=S, ordinal=L)
DICTIONARY_KINDS = ("standard_terms", "synonym_map", "near_synonym_map", "stopwords", "exclusion_terms", "phrase_lexicon", "custom_lexicon", "regex_rules")


def as_corpus(df: DataFrame) -> DataFrame:
    """df with every corpus column: missing ones are null, columns of its own stay behind them."""
    have = set(df.columns)
    own = [c for c in df.columns if c not in CORPUS.names]
    made = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in CORPUS.fields]
    return df.select(*made, *own)


def lookup(df: DataFrame, name: str) -> Column:
    """A field as text: a column, else a path a.b through structs and maps, else
    a key of extra_metadata, else null."""
    if name in df.columns:
        return F.col(f"`{name}`").cast("string")
    head, *steps = name.split(".")
    if steps and head in df.columns and (found := _inner(F.col(head), df.schema[head].dataType, steps)) is not None:
        return found.cast("string")
    if "extra_metadata" in df.columns and isinstance(df.schema["extra_metadata"].dataType, T.MapType):
        return F.try_element_at("extra_metadata", F.lit(name.removeprefix("extra_metadata.")))
    return F.lit(None).cast("string")


def _inner(value: Column, kind: T.DataType, steps: list[str]) -> Column | None:
    """The value at a path, None if the schema has no such path; the last map takes the rest of it as its key."""
    if not steps:
        return value
    if isinstance(kind, T.StructType) and steps[0] in kind.names:
        return _inner(value.getField(steps[0]), kind[steps[0]].dataType, steps[1:])
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        if isinstance(kind.valueType, T.StructType | T.MapType):
            return _inner(F.try_element_at(value, F.lit(steps[0])), kind.valueType, steps[1:])
        return F.try_element_at(value, F.lit(".".join(steps)))
    return None
