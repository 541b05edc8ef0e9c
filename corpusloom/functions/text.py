"""Scalar text functions as Column expressions, evaluated inside the JVM wherever Spark can.

Python's ``\\s``, ``\\w`` and ``lower`` know all of Unicode, so patterns carry ``(?U)``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------

#: One token per Chinese character, per run of ASCII word characters, per other non-space character.
TOKEN = r"[一-鿿]|[A-Za-z0-9_]+|[^\sA-Za-z0-9_一-鿿]"
CJK = r"[一-鿿]"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words the evidence builder ignores.
EVIDENCE_STOPWORDS = (
    "the", "a", "an", "of", "in", "on", "at", "to", "for", "and", "or", "is",
    "are", "was", "were", "be", "what", "which", "who", "when", "where", "how",
    "why", "does", "do", "did", "that", "this", "it", "its", "with", "by",
    "from", "as", "after", "before",
)
HTML_TABLE = r"(?is)<table\b.*?</table>"
MARKDOWN_IMAGE = r"!\[[^\]]*\]\([^)]+\)"
MARKDOWN_LINK = r"(?<!!)\[[^\]]+\]\([^)]+\)"
_SPACES = r"[   -​  　]"


# --- normalising ------------------------------------------------------------------------------


def _nfkc(c: Column) -> Column:
    @F.arrow_udf("string")
    def nfkc(text: pa.Array) -> pa.Array:
        return by_slices(text, lambda s: normalize("NFKC", s.replace("\ufeff", "")), pa.string())

    return nfkc(c)


def by_slices(values: pa.Array, make: Callable, kind: pa.DataType, *, size: int = 256) -> pa.Array:
    """``make`` of each value that is not null; only a slice's values are Python objects at a time, whatever an Arrow batch holds."""
    parts = [pa.array([None if x is None else make(x) for x in values.slice(i, size).to_pylist()], kind) for i in range(0, len(values), size)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def count_terms(text: Column, terms: Column) -> Column:
    """Occurrences of all terms in a text as substrings, repeats of a term counting again."""
    return F.coalesce(F.aggregate(terms, F.lit(0).cast("long"), lambda n, t: n + occurrences(text, t)), F.lit(0).cast("long"))


def normalize_text(c: Column) -> Column:
    """BOM dropped, NFKC, line feeds unified, odd spaces to spaces, typographic marks to ASCII."""
    # NFKC leaves pure ASCII alone, so only other texts go through Python, as nulls do
    c = F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, _SPACES, " ")
    c = F.translate(c, "‘’“”–—−", "''\"\"---")
    return F.replace(c, F.lit("…"), F.lit("..."))


def squeeze_line(c: Column) -> Column:
    """Runs of blanks and tabs to one blank, then trimmed."""
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]{2,}", " "), r"(?U)^\s+|\s+$", "")


def normalize_line(c: Column) -> Column:
    return squeeze_line(normalize_text(c))


def clean_text(c: Column) -> Column:
    """Trimmed, a JSON string literal unwrapped, line feeds unified."""
    t = F.trim(c)
    quoted = F.get_json_object(F.concat(F.lit('{"v":'), t, F.lit("}")), "$.v")
    return F.regexp_replace(F.when(t.rlike('(?s)^".*"$'), F.coalesce(quoted, t)).otherwise(t), "\r\n?", "\n")


def clean_control(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"[\x00-\x1f\x7f-\x9f]", "")


def normalize_entity_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"(?U)\s+", " ")


def normalize_answer(c: Column) -> Column:
    c = F.translate(F.lower(c), PUNCTUATION, "")
    c = F.regexp_replace(c, r"(?U)\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def alnum_key(c: Column) -> Column:
    """Lower-case ASCII letters and digits with single blanks."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def quoteless_key(c: Column) -> Column:
    """Lower case without quotes and possessive endings, blanks collapsed."""
    c = F.regexp_replace(F.lower(F.trim(c)), r"['’]s\b", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[\"'`]", ""), r"(?U)\s+", " "))


# --- counting ---------------------------------------------------------------------------------


def count_tokens(c: Column) -> Column:
    return F.regexp_count(c, F.lit("(?U)" + TOKEN)).cast("int")


def cue_cost(c: Column) -> Column:
    cjk = F.regexp_count(c, F.lit(CJK))
    return (cjk + F.ceil((F.char_length(c) - cjk) / 4)).cast("int")


def occurrences(text: Column, term: Column) -> Column:
    """Occurrences of a substring that do not overlap."""
    gone = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return F.when(F.length(term) > 0, (gone / F.length(term)).cast("int")).otherwise(0)


# --- ids and locates --------------------------------------------------------------------------


def short_sha1(c: Column, n: int) -> Column:
    return F.substring(F.sha1(c.cast("binary")), 1, n)


def entity_id(name: Column) -> Column:
    return F.concat(F.lit("entity:"), short_sha1(normalize_entity_name(name), 12))


def raptor_id(title: Column, path: Column, chunk_ids: Column) -> Column:
    seed = F.concat_ws("|", title, F.array_join(path, ">"), F.array_join(chunk_ids, ","))
    return F.concat(F.lit("raptor:"), short_sha1(seed, 16))


def json_text(c: Column) -> Column:
    """A JSON string literal with non-ASCII characters as they are."""
    one = F.to_json(F.struct(c.alias("v")))
    return F.substring(one, 6, 2**31 - 1).substr(F.lit(1), F.length(one) - 6)


def edge_id(edge_type: Column, relation_types: Column, source: Column, target: Column) -> Column:
    """Hash of the edge's JSON with sorted keys and blanks after separators."""
    types = F.concat(F.lit("["), F.array_join(F.transform(relation_types, json_text), ", "), F.lit("]"))
    body = F.concat(
        F.lit('{"edge_type": '), json_text(edge_type), F.lit(', "relation_types": '), types,
        F.lit(', "source": '), json_text(source), F.lit(', "target": '), json_text(target), F.lit("}"),
    )
    return F.concat(F.lit("edge:"), short_sha1(body, 16))


def md5_id(c: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.md5(c.cast("binary")))


def locate(file_name: Column, start: Column, end: Column) -> Column:
    return F.concat(file_name, F.lit(":L"), start.cast("string"), F.lit("-L"), end.cast("string"))


def parse_locate(c: Column, *, tolerant: bool = False) -> Column:
    """struct(file_name, start_line, end_line); null if it is no locate.

    The tolerant form also takes one line and numbers without L.
    """
    pattern = r"(?s)^(.+):L?(\d+)(?:-L?(\d+))?$" if tolerant else r"(?s)^(.+):L(\d+)-L(\d+)$"
    start = F.regexp_extract(c, pattern, 2).try_cast("int")
    end = F.regexp_extract(c, pattern, 3)
    end = F.when(end == "", start).otherwise(end.try_cast("int"))
    found = F.struct(F.regexp_extract(c, pattern, 1).alias("file_name"), start.alias("start_line"), end.alias("end_line"))
    return F.when(c.rlike(pattern), found)


def index_name(namespace: Column, suffix: str) -> Column:
    safe = F.regexp_replace(F.regexp_replace(F.lower(namespace), "[^a-z0-9_-]+", "-"), "^-+|-+$", "")
    return F.when(safe == "", F.raise_error(F.lit("empty namespace"))).otherwise(F.concat(safe, F.lit(suffix)))


# --- headings and placeholders ----------------------------------------------------------------

#: Fixed values: (pattern, level) in the order they are tried; None: the level depends on the match.
HEADINGS: tuple[tuple[str, int | None], ...] = (
    (r"(?U)^(#{1,6})\s+(.+?)\s*$", None),
    (r"(?U)^第[一二三四五六七八九十百千万\d]+[章节篇部卷编]\s*[、:：.\-]?\s*(.+)?$", 1),
    (r"(?U)^第[一二三四五六七八九十百千万\d]+[条款项节]\s*[、:：.\-]?\s*(.+)?$", 2),
    (r"(?Ui)^(ARTICLE|CHAPTER|PART)\s+([IVXLCDM\d]+)\b[.\s:-]*(.*)$", 1),
    (r"(?U)^(Section|SECTION)\s+\d+(\.\d+)*\b[.\s:-]*(.*)$", 2),
    (r"(?U)^\d+(\.\d+){1,5}\s+.{2,120}$", None),
)


def heading_level(c: Column) -> Column:
    """Level of a heading line, or null."""
    out = F.when(c.rlike(HEADINGS[0][0]), F.length(F.regexp_extract(c, HEADINGS[0][0], 1)))
    out = out.when(c.rlike(HEADINGS[1][0]), 1)
    out = out.when(c.rlike(HEADINGS[2][0]), F.when(F.substring(c, 1, 12).contains("条"), 3).otherwise(2))
    out = out.when(c.rlike(HEADINGS[3][0]), 1).when(c.rlike(HEADINGS[4][0]), 2)
    dots = F.length(F.regexp_extract(c, r"^([\d.]+)", 1)) - F.length(F.replace(F.regexp_extract(c, r"^([\d.]+)", 1), F.lit("."), F.lit("")))
    return out.when(c.rlike(HEADINGS[5][0]), F.least(dots + 1, F.lit(6))).cast("int")


def heading_title(c: Column) -> Column:
    return F.when(c.rlike(HEADINGS[0][0]), F.trim(F.regexp_extract(c, HEADINGS[0][0], 2))).otherwise(c)


def placeholders(line: Column, line_no: Column) -> Column:
    """array of struct(placeholder, type, line_no, raw) found in a line."""

    def of(kind: str, pattern: str) -> Column:
        return F.transform(
            F.regexp_extract_all(line, F.lit(pattern), F.lit(0)),
            lambda raw, i: F.struct(
                F.concat(F.lit(f"[{kind}_"), line_no.cast("string"), F.lit("_"), (i + 1).cast("string"), F.lit("]")).alias("placeholder"),
                F.lit(kind).alias("type"), line_no.cast("int").alias("line_no"), raw.alias("raw"),
            ),
        )

    return F.concat(of("table", HTML_TABLE), of("image", MARKDOWN_IMAGE), of("link", MARKDOWN_LINK))


# --- tokenizers (they differ on purpose) --------------------------------------------------------


def agent_terms(c: Column) -> Column:
    """ASCII word runs and Chinese runs of two characters and more, repeats kept."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"[a-zA-Z0-9_]+|[一-鿿]{2,}"), F.lit(0))
    return F.filter(found, lambda t: F.length(t) >= 2)


def flat_terms(c: Column) -> Column:
    """Runs of Unicode letters and digits, longer than one."""
    found = F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " ")
    return F.filter(found, lambda t: F.length(t) > 1)


def iso_terms(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit(r"[A-Za-z0-9一-鿿]+"), F.lit(0))
    return F.filter(found, lambda t: F.length(t) >= 2)


def ascii_terms(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: F.length(t) > 1)


def clue_terms(c: Column, stopwords: Sequence[str] = ()) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_except(F.filter(found, lambda t: F.length(t) > 2), F.array(*map(F.lit, stopwords)).cast("array<string>"))


def evidence_tokens(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9一-鿿]+"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, EVIDENCE_STOPWORDS)))


def standard_tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, as a full-text index cuts them."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


# --- answers, judges, numbers -------------------------------------------------------------------


def extract_answer(c: Column) -> Column:
    """The answer tag's content, else the text without its thinking part; then the JSON answer, if any."""
    tagged = F.regexp_extract(c, r"(?is)<answer>(.*?)</answer>", 1)
    text = F.when(c.rlike(r"(?is)<answer>.*?</answer>"), F.trim(tagged)).otherwise(F.trim(F.regexp_replace(c, r"(?is)<think>.*?</think>", "")))
    return F.coalesce(F.get_json_object(F.when(text.startswith("{"), text), "$.answer"), text)


def prediction_text(answer: Column, rationale: Column) -> Column:
    tagged = F.concat(F.lit("<answer>"), answer, F.lit("</answer>"))
    return F.when(F.coalesce(rationale, F.lit("")) == "", tagged).otherwise(F.concat(F.lit("<think>"), rationale, F.lit("</think>\n"), tagged))


def thought_and_answer(c: Column) -> Column:
    at = F.instr(c, "Answer:")
    return F.struct(
        F.trim(F.when(at > 0, F.substr(c, F.lit(1), at - 1)).otherwise("")).alias("thought"),
        F.trim(F.when(at > 0, F.substr(c, at + 7)).otherwise(c)).alias("answer"),
    )


def judge_value(c: Column) -> Column:
    """1, 0 or null from numbers (0.5 and more is 1) and words."""
    n = c.try_cast("double")
    word = F.lower(F.trim(c))
    return (
        F.when(n.isNotNull(), F.when(n >= 0.5, 1.0).otherwise(0.0))
        .when(word.isin("true", "yes", "correct", "y"), 1.0)
        .when(word.isin("false", "no", "incorrect", "n", "wrong"), 0.0)
    )


def judge_score(c: Column) -> Column:
    n = F.regexp_extract(c, r"(?is)<score>\s*(-?\d+(?:\.\d+)?)\s*</score>", 1).try_cast("double")
    return F.when(n.isNotNull(), F.least(F.greatest(n, F.lit(0.0)), F.lit(10.0)) / 10)


def split_sentences(c: Column, least: int = 20) -> Column:
    parts = F.transform(F.split(c, r"(?U)(?<=[.!?])\s+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) >= least)


def split_evenly(c: Column, parts: Column) -> Column:
    size = F.greatest(F.ceil(F.length(c) / parts), F.lit(1)).cast("int")
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(c) / size).cast("int") - 1, F.lit(0)))
    return F.transform(starts, lambda i: F.substr(c, i * size + 1, size))


def content_with_path(path: Column, text: Column) -> Column:
    return F.when(F.size(path) > 0, F.concat(F.array_join(path, " > "), F.lit("\n\n[CONTENT]\n\n"), text)).otherwise(text)


def guess_type(name: Column, concepts: str = "cancer|graph|ppr|retrieval") -> Column:
    """CONCEPT by keyword (a corpus adds its own), ORG by short capitals, CONCEPT by Chinese cue, else OTHER."""
    caps = (F.upper(name) == name) & (F.lower(name) != name) & (F.length(name) <= 8)
    return (
        F.when(name.rlike(f"(?i){concepts}"), "CONCEPT")
        .when(caps, "ORG")
        .when(name.rlike("章|节|条|款|图|结构|检索|推荐"), "CONCEPT")
        .otherwise("OTHER")
    )


def decompose(question: Column, most: int = 3) -> Column:
    parts = F.filter(F.transform(F.split(question, r"[？?。；;\n]+"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.slice(parts, 1, most)).otherwise(F.array(F.trim(question)))


def to_number(c: Column, default: float = 0.0) -> Column:
    """A number as well as it can be read, else the default."""
    return F.coalesce(c.try_cast("double"), F.lit(default))


def number_or_count(c: Column) -> Column:
    """A number, or how many entries a JSON list has; 0 for anything else."""
    return F.coalesce(c.try_cast("double"), F.json_array_length(F.when(F.trim(c).startswith("["), c)).cast("double"), F.lit(0.0))


def safe_div(a: Column, b: Column) -> Column:
    """Null where the ratio is undefined."""
    return F.try_divide(a, b)


# --- weights and predicates ---------------------------------------------------------------------


def omega_vertical(hop: Column) -> Column:
    return 1.0 / (1.0 + hop)


def omega_horizontal(delta: Column) -> Column:
    return 1.0 / (1.0 + F.abs(delta))


def omega_semantic(weight: Column, support: Column) -> Column:
    return F.greatest(weight, F.lit(1.0)) * F.log1p(support)


def omega_provenance(fraction: Column) -> Column:
    return F.least(F.greatest(fraction, F.lit(0.0)), F.lit(1.0))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column, *, touch: bool = False) -> Column:
    gap = 1 if touch else 0
    return F.coalesce((a0 <= b1 + gap) & (b0 <= a1 + gap), F.lit(False))


def unit_in_text(unit: Column, text: Column, *, strict_short: bool = False) -> Column:
    """Substring, or three quarters of the unit's distinct tokens; strictly all of one or two."""
    u, t = F.array_distinct(F.split(unit, " ")), F.split(text, " ")
    share = F.size(F.array_intersect(u, t)) / F.size(u)
    need = F.when((F.size(u) <= 2) & F.lit(strict_short), 1.0).otherwise(0.75)
    return (unit != "") & (text.contains(unit) | (share >= need))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def unit_vector(v: Column) -> Column:
    with_norm = let(v, lambda x: F.struct(x.alias("x"), F.sqrt(dot(x, x)).alias("n")))
    return let(with_norm, lambda s: F.transform(s["x"], lambda x: x.cast("double") / F.when(s["n"] == 0, 1.0).otherwise(s["n"])))


def hash_embedding(text: Column, dim: int) -> Column:
    """Signed hashing of lower-case tokens between blanks, L2-normalised; all in the JVM."""
    tokens = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda t: t != "")
    coded = F.transform(
        F.transform(tokens, lambda t: F.sha2(t, 256)),
        lambda h: F.struct(
            (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dim).alias("i"),
            F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0).alias("s"),
        ),
    )
    raw = let(
        coded,
        lambda cs: F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda k: F.aggregate(F.filter(cs, lambda c: c["i"] == k), F.lit(0.0), lambda a, c: a + c["s"]),
        ),
    )
    return unit_vector(raw)
