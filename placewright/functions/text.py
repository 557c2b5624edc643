"""Column expressions on names and other texts; all stay inside whole-stage code."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Traditional characters and their simplified forms, as search folds them.
TRADITIONAL = "復興園醫學國鐵車門廣場東橋碼頭聖寧灣總會"
SIMPLIFIED = "复兴园医学国铁车门广场东桥码头圣宁湾总会"
# Names that say what a place is, but not which one.
GENERIC_NAMES = ("building", "buildings", "house", "school", "temple", "church", "hospital", "factory", "bank", "shop", "cemetery", "residence", "garden", "hotel")
# What a place key leaves out at its start and end, and keys that name a kind of place or a numbered house only.
PLACE_START, PLACE_END = "^上海市?", "(?:旧址|旧居|原址|遗址|历史建筑|优秀历史建筑)$"
KINDS_OF_PLACE = (
    "vanished|none|null|unknown|yes|no|名称未载|住宅|花园住宅|民宅|民居|住宅楼|居民住宅|公寓|里弄|公寓楼|花园|公园|楼|建筑|建筑群|花园洋房|办公|办公楼|办公用房|办公室|综合办公楼|商业|商店|商铺|商场|学校|校舍|中学|大学|医院|厂房|仓库|码头|银行|教堂|寺庙"
    "|多户住宅|多单位使用|多户居住|其他|居住|宿舍|house|residence|residentialbuilding|hospital|school|building|villa|garden|park|factory|church|bank|office|temple"
)
NUMBERED_HOUSE = r"第?[一二三四五六七八九十0-9]+[号栋楼幢座]|\d+号住宅"
# Placeholders that stand where a name should.
PLACEHOLDERS = ("VANISHED", "NONE", "NO", "YES", "NULL")
# Small words and numerals of title case.
PARTICLES = ("de", "du", "des", "la", "le", "les", "et", "of", "the", "and", "d", "l")


@lru_cache
def fold_table() -> tuple[str, str]:
    """Every precomposed Latin letter with its base letter, by Unicode's own decompositions."""
    pairs = [(chr(c), d[0]) for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFKD", chr(c))) > 1 and d[0].isalpha() and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def clean(c: Column) -> Column:
    """Null as empty, NUL bytes out, Unicode blanks off both ends."""
    return F.regexp_replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("\0"), F.lit("")), r"^[\s\u00a0\u3000\u2000-\u200a]+|[\s\u00a0\u3000\u2000-\u200a]+$", "")


def latin_fold(c: Column) -> Column:
    """Accents off Latin letters, combining marks out."""
    return F.regexp_replace(F.translate(clean(c), *fold_table()), r"[\u0300-\u036f]", "")


def words(c: Column) -> Column:
    """Upper-case words of letters and digits with single spaces."""
    plain = F.regexp_replace(F.regexp_replace(F.upper(latin_fold(c)), "[’‘`´]", "'"), "&", " AND ")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def compact(c: Column) -> Column:
    return F.replace(words(c), F.lit(" "), F.lit(""))


def are_variants(a: Column, b: Column) -> Column:
    """Whether two names are spellings of one: equal when compacted, or, from six letters on, within a tenth of edits."""
    x, y = compact(a), compact(b)
    shorter = F.least(F.length(x), F.length(y))
    close = (shorter >= 6) & (F.abs(F.length(x) - F.length(y)) <= 2) & (F.levenshtein(x, y) <= F.greatest(F.lit(1), F.floor(shorter / 10)))
    return (x != "") & (y != "") & ((x == y) | close)


def is_generic(c: Column) -> Column:
    return F.lower(words(c)).isin(*GENERIC_NAMES)


def is_placeholder(c: Column) -> Column:
    return c.rlike(f"(?i)^({'|'.join(PLACEHOLDERS)})$")


def specificity(name: Column, name_zh: Column, n_types: Column, start: Column) -> Column:
    """How much a record says: longer names and more words, then extra facts; names of a kind only come last."""
    w = words(name)
    tokens = F.when(w == "", 0).otherwise(F.size(F.split(w, " ")))
    return (
        F.least(F.length(w), F.lit(80)) + tokens * 8 + F.least(F.length(F.coalesce(name_zh, F.lit(""))), F.lit(24)) + F.least(F.coalesce(n_types, F.lit(0)), F.lit(5))
        + F.when(start > 0, 2).otherwise(0) - F.when(is_generic(name), 200).otherwise(0)
    ).cast("int")


def search_key(c: Column) -> Column:
    """What search compares: folded, simplified, lower case, with apostrophes, dots and hyphens as spaces."""
    own = F.lower(F.translate(latin_fold(c), TRADITIONAL, SIMPLIFIED))
    return F.trim(F.regexp_replace(F.regexp_replace(own, "[’'`.-]", " "), r"\s+", " "))


def slug(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(latin_fold(c)), "[^a-z0-9㐀-鿿]+", "-"), "^-+|-+$", ""), 1, 72)


def year_in(c: Column) -> Column:
    return F.regexp_extract(c, r"((?:18|19)\d{2})", 1).try_cast("int")


def years_in(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"((?:18|19)\d{2})"), F.lit(1)), lambda y: y.cast("int"))


def title(c: Column) -> Column:
    """Title case that keeps mixed case and numerals, and leaves particles small but at the start."""
    def word(w, i):
        low = F.lower(w)
        return F.when(w.rlike("^[IVXLC]+$"), w).when((i > 0) & low.isin(*PARTICLES), low).when((w != F.upper(w)) & (w != low), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))))
    return F.array_join(F.transform(F.split(clean(c), r"\s+"), word), " ")


def nullable(c: Column) -> Column:
    return F.nullif(clean(c), F.lit(""))


def half_up(c: Column, digits: int = 0) -> Column:
    """Rounding that sends halves up, also below zero."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def period(start: Column, end: Column) -> Column:
    """A half-known interval in words; null where nothing is known."""
    return F.when(start.isNotNull() & end.isNotNull(), F.when(start == end, start.cast("string")).otherwise(F.concat_ws("–", start, end))).when(start.isNotNull(), F.concat(F.lit("from "), start)).when(end.isNotNull(), F.concat(F.lit("until "), end))


def first_rule(c: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first pattern that matches."""
    out = F
    for pattern, label in rules:
        out = out.when(c.rlike(pattern), label)
    return out.otherwise(otherwise)


def all_rules(c: Column, rules: list[tuple[str, str]], between: str = r"[\s/;,]+") -> Column:
    """The labels of the first matching pattern of each part of a text, without repeats, in order."""
    def one(p):
        out = F
        for pattern, label in rules:
            out = out.when(p.rlike(pattern), F.lit(label))
        return out
    return F.array_distinct(F.filter(F.transform(F.split(c, between), one), lambda x: x.isNotNull()))


def redact(url: Column) -> Column:
    return F.regexp_replace(url, "([?&]key=)[^&]*", "$1…")


def url_key(url: Column) -> Column:
    """Host without www, path and query, lower case."""
    host = F.regexp_replace(F.lower(F.parse_url(url, F.lit("HOST"))), r"^www\.", "")
    query = F.parse_url(url, F.lit("QUERY"))
    return F.lower(F.concat(host, F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), F.when(query.isNotNull(), F.concat(F.lit("?"), query)).otherwise("")))


def place_key(c: Column) -> Column:
    """What place names are compared by: one width, simplified, lower case, without marks and blanks, city and old-site endings."""
    wide = "".join(chr(0xFEE0 + i) for i in range(0x21, 0x7F))
    own = F.lower(F.translate(F.translate(clean(c), wide, "".join(map(chr, range(0x21, 0x7F)))), TRADITIONAL, SIMPLIFIED))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(own, r"[\p{P}\p{Z}\s]", ""), PLACE_START, ""), PLACE_END, "")


def place_variants(c: Column) -> Column:
    """The spellings that one field holds: itself, its parts between marks, what stands in brackets, and the rest without them."""
    own = F.coalesce(c, F.lit(""))
    inside = F.regexp_extract_all(own, F.lit("[（(]([^）)]+)[）)]"), F.lit(1))
    every = F.concat(F.array(own), F.split(own, "[\n；;、/／]"), inside, F.array(F.regexp_replace(own, "[（(][^）)]*[）)]", "")))
    return F.array_distinct(F.filter(F.transform(every, F.trim), lambda v: v != ""))


def names_a_place(key: Column) -> Column:
    """Whether a place key says which place: long enough for its script, and neither a kind of place nor a numbered house."""
    least = F.when(key.rlike("[\u3400-\u9fff]"), 3).otherwise(5)
    return (F.length(key) >= least) & ~key.rlike(f"^(?:{KINDS_OF_PLACE})$") & ~key.rlike(f"^(?:{NUMBERED_HOUSE})$")
