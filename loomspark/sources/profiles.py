"""Import profiles: which source columns feed which corpus fields.

A rule's line is `target: column | alias | ...`; a star after the target marks a
required column. `text` lists the columns that are joined to the document's text.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

# Column names of the export formats of common sources.
PROFILES = {
    "generic": """
        doc_id: doc_id | id | document_id
        title: title | name | subject
        raw_text: abstract | raw_text | content | text | summary
        year: year | published | publication_year
        source: source | journal | origin
        author: author | authors | creator
        institution: institution | org | organization | affiliation
        country_or_region: country_or_region | country | region
        category_or_tag: category_or_tag | category | tag
        keyword_field: keyword_field | keywords | keyword
        text: title | abstract
    """,
    "literature": """
        title*: title | Title | article_title
        raw_text*: abstract | Abstract | summary
        year: year | PY | published | publication_year
        source: source | journal | SO
        author: author | authors | AU
        institution: institution | org | affiliation | C1
        keyword_field: keyword_field | keywords | DE
        category_or_tag: category_or_tag | category | WC
        text: title | abstract
    """,
    "wos": """
        doc_id*: UT | Accession Number | UT (Unique WOS ID)
        title*: TI | Article Title
        raw_text*: AB | Abstract
        year: PY | Published Year | Publication Year
        source: SO | Publication Name | Source Title
        author: AU | Authors
        institution: C1 | Addresses | Affiliations
        keyword_field: DE | Author Keywords
        keyword_field: ID | Keywords Plus
        category_or_tag: WC | Web of Science Categories | WoS Categories
        extra_metadata: DOI
        extra_metadata: DT | Document Type
        text: TI | AB | DE | ID
    """,
    "scopus": """
        doc_id*: EID
        title*: Title | Article Title
        raw_text*: Abstract | abstract
        year: Year | Publication Year
        source: Source title | Journal
        author: Authors | Author full names
        institution: Affiliations | Author affiliations
        keyword_field: Author Keywords | Index Keywords
        keyword_field: Index Keywords | Author Keywords
        category_or_tag: Subject area | Subject areas
        extra_metadata: DOI
        text: Title | Abstract | Author Keywords | Index Keywords
    """,
    "patent": """
        doc_id*: publication_number | pn | patent_no | 公开（公告）号
        title*: title | invention_title | 标题 | 专利名称
        raw_text*: abstract | 摘要 | abstract_text
        year: publication_year | year | 公开（公告）日
        institution: applicant | assignee | 申请人
        author: inventor | 发明人
        category_or_tag: ipc | IPC | IPC分类号
        keyword_field: keywords | 主题词
        text: title | abstract | keywords
    """,
    "incopat": """
        doc_id*: 公开（公告）号 | 公开(公告)号 | 申请号 | 专利号 | 公开号 | 授权公告号 | 首次公开号
        title*: 标题 (中文) | 标题（中文） | 标题(中文) | 标题 | 专利名称 | 标题 (英文) | 标题（英文） | 标题(英文) | 标题（小语种原文）
        raw_text*: 摘要 (中文) | 摘要（中文） | 摘要(中文) | 摘要 | 摘要 (英文) | 摘要（英文） | 摘要(英文) | 摘要（小语种原文） | 首权翻译 | 首项权利要求 | 独立权利要求 | 简介
        year: 公开（公告）日 | 公开(公告)日 | 申请日 | 优先权日 | 最早优先权日 | 年份 | 首次公开日 | 授权公告日
        institution: 申请人 | 标准化申请人 | 当前权利人 | 标准化当前权利人 | 第一申请人 | 专利权人 | 申请人(翻译) | 申请人（翻译）
        author: 发明人 | 第一发明(设计)人 | 第一发明（设计）人 | 发明(设计)人(其他) | 发明（设计）人（其他） | Inventor
        country_or_region: 公开国别 | 申请人国家/地区 | 优先权国别 | 同族国家/地区
        category_or_tag: IPC | IPC分类号 | IPC主分类-小组 | CPC
        keyword_field: 技术功效短语 | 技术功效句 | 用途 | 关键词 | 主题词
        extra_metadata: 引证专利
        extra_metadata: 被引证专利
        extra_metadata: 被引证次数
        extra_metadata: 引证次数
        extra_metadata: 技术功效1级 | 技术功效2级 | 技术功效3级
        text: 标题 (中文) | 标题 (英文) | 摘要 (中文) | 摘要 (英文) | 首权翻译 | 首项权利要求 | 独立权利要求 | 技术功效句 | 技术功效短语 | 用途
    """,
    "business_reserved": """
        doc_id: record_id | id
        title*: title | subject
        raw_text*: content | raw_text | text
        year: year | published_year
        institution: company | institution | organization
        category_or_tag: topic | category
        keyword_field: keywords | tags
        text: title | content
    """,
}


@dataclass(frozen=True)
class Rule:
    target: str
    names: tuple[str, ...]
    required: bool = False


@dataclass(frozen=True)
class Template:
    profile: str
    rules: tuple[Rule, ...]
    text: tuple[str, ...]
    delimiter: str = "\n\n"
    skip_empty: bool = True

    def fingerprint(self) -> str:
        """The hash of an import specification; equal settings have equal hashes."""
        plain = json.dumps(asdict(self), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        return "sha256:" + hashlib.sha256(plain.encode()).hexdigest()


def saved(spec: Template, name: str) -> str:
    """An import specification as JSON, under a name and with its fingerprint."""
    return json.dumps({"name": name, "fingerprint": spec.fingerprint(), "specification": asdict(spec)}, ensure_ascii=False, indent=2)


def restored(text: str) -> Template:
    """The specification of such a JSON text; ValueError if its settings don't have its fingerprint."""
    whole = json.loads(text)
    plain = whole["specification"]
    rules = tuple(Rule(r["target"], tuple(r["names"]), r["required"]) for r in plain["rules"])
    spec = Template(plain["profile"], rules, tuple(plain["text"]), plain["delimiter"], plain["skip_empty"])
    if spec.fingerprint() != whole["fingerprint"]:
        raise ValueError(f"the import specification {whole.get('name')} was changed")
    return spec


def parse(text: str, profile: str = "generic", **options) -> Template:
    """A template from rule lines."""
    rules, parts = [], ()
    for line in filter(None, map(str.strip, text.splitlines())):
        target, names = line.split(":", 1)
        names = tuple(n.strip() for n in names.split("|"))
        if target == "text":
            parts = names
        else:
            rules.append(Rule(target.rstrip("*"), names, target.endswith("*")))
    return Template(profile, tuple(rules), parts or ("raw_text",), **options)


def template(profile: str = "generic", **options) -> Template:
    """A profile's template; unknown profiles are generic."""
    profile = profile if profile in PROFILES else "generic"
    return parse(PROFILES[profile], profile, **options)
