"""Text checks and scalar functions as Column expressions; patterns are kept within what both Java and RE2 accept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import BRACKETS, COUNT_MANDATORY, STOPWORDS

# Patterns.
TAG = r"<(/?[A-Za-z][A-Za-z0-9:_-]*)[^<>]*>"
URL = r"https?://[!#-&(-;=?-~]+"
EMAIL = r"[A-Za-z0-9._+-]+@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}"
MOJIBAKE = "[ÃÂâÐÑ][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"
INVISIBLE = "[​  ‪-‮\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]|[^﻿]﻿"
DOUBLE_ESCAPED = r"&amp;(amp;|lt;|gt;|quot;|#|nbsp;)"
ENDS_SENTENCE = r"[:.!?…][\s\p{Z}]*$"
ENDS_WORD = r"[\p{L}\p{N}][\s\p{Z}]*$"
FLAT_PLACEHOLDER = r"%[0-9]+\$[a-zA-Z@]|\{\{ *[A-Za-z0-9_.-]+ *\}\}|\{[A-Za-z0-9_.-]+\}"
EDGE_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def trimmed(c: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(c, EDGE_SPACE, "")


def language(locale: Column) -> Column:
    return F.lower(F.split(locale, "[-_]")[0])


def letters(c: Column) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, r"\p{L}", ""))


def prose(c: Column) -> Column:
    """Without tags, flat placeholders and printf conversions."""
    return F.regexp_replace(c, TAG + "|" + FLAT_PLACEHOLDER + r"|%[a-zA-Z@]", "")


def is_key(source: Column) -> Column:
    return ~source.rlike(r"[\s\p{Z}]") & source.contains(".") & ~source.contains("://")


def tags(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(TAG), F.lit(1)), lambda x: F.lower(x))


def links(c: Column) -> Column:
    urls = F.transform(F.regexp_extract_all(c, F.lit(URL), F.lit(0)), lambda x: F.regexp_replace(x, r"[.,;:)\]!?]+$", ""))
    return F.concat(F.filter(urls, lambda x: F.length(x) > 8), F.regexp_extract_all(c, F.lit(EMAIL), F.lit(0)))


def count_of(c: Column, mark: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(mark)))


# ---- checks: true where a translation has the defect -----------------------------------------------------------------


def blank(s: Column, t: Column) -> Column:
    return (trimmed(t) == "") & (trimmed(s) != "")


def _present(t: Column) -> Column:
    return trimmed(t) != ""


def identical(s: Column, t: Column, source_locale: Column, locale: Column) -> Column:
    p = prose(trimmed(s))
    many = (letters(p) > 3) & (F.regexp_replace(p, r"[^\p{L}]", "").rlike(r"[^\p{Lu}]"))
    return _present(t) & (language(source_locale) != language(locale)) & many & (trimmed(s) == trimmed(t))


def markup(s: Column, t: Column) -> Column:
    return _present(t) & (F.array_sort(tags(s)) != F.array_sort(tags(t)))


def whitespace(s: Column, t: Column) -> Column:
    def edge(c: Column, at: str) -> Column:
        return F.regexp_extract(c, at, 0)

    lead, trail = r"^[\s\p{Z}]*", r"[\s\p{Z}]*$"
    return (trimmed(s) != "") & _present(t) & ((edge(s, lead) != edge(t, lead)) | (edge(s, trail) != edge(t, trail)))


def punctuation(s: Column, t: Column) -> Column:
    return s.rlike(ENDS_SENTENCE) & (letters(s) >= 4) & t.rlike(ENDS_WORD)


def length(s: Column, t: Column, ratio: float = 2.5, slack: int = 8) -> Column:
    a, b = F.length(trimmed(s)), F.length(trimmed(t))
    return _present(t) & ~is_key(trimmed(s)) & (((b > a * ratio + slack) & (a >= 4)) | (a > b * ratio + slack))


def encoding(t: Column) -> Column:
    return t.rlike(MOJIBAKE)


def invisible(t: Column) -> Column:
    return t.rlike(INVISIBLE)


def link(s: Column, t: Column) -> Column:
    a, b = links(s), links(t)
    return ~is_key(s) & ((F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0))


def brackets(s: Column, t: Column) -> Column:
    pairs = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(c).alias("c")) for o, c in BRACKETS])
    n = lambda text, mark: F.length(text) - F.length(F.replace(text, mark))
    return ~is_key(s) & F.exists(pairs, lambda p: (n(s, p["o"]) == n(s, p["c"])) & (n(t, p["o"]) != n(t, p["c"])))


def entities(t: Column) -> Column:
    return t.rlike(DOUBLE_ESCAPED)


def unnumbered_arguments(t: Column) -> Column:
    """Two or more printf arguments without a number."""
    bare = F.regexp_replace(F.regexp_replace(t, "%%", ""), r"%[0-9]", "")
    return F.size(F.regexp_extract_all(bare, F.lit(r"%[A-Za-z.-]"), F.lit(0))) >= 2


def android_escape(t: Column) -> Column:
    """error, warning or null: resource references that aren't, bare apostrophes, odd double quotes."""
    bare = F.regexp_replace(F.regexp_replace(t, r"\\.", ""), r"<[^>]*>", "")
    exempt = t.contains("<![CDATA[") | trimmed(t).rlike(r'(?s)^".*"$')
    reference = trimmed(t).rlike(r"^[@?]") & ~trimmed(t).rlike(r"^[@?][A-Za-z0-9_.+:]+/?[A-Za-z0-9_.]*$")
    return F.when(reference, "error").when(~exempt & bare.contains("'"), "error").when(~exempt & (count_of(bare, '"') % 2 == 1), "warning")


# ---- keys, locales, directives ---------------------------------------------------------------------------------------


def plural_base(key: Column) -> Column:
    """'' unless the key is base#plural.category."""
    return F.regexp_extract(key, r"(?s)^(.*)#plural\.([^#]+)$", 1)


def plural_category(key: Column) -> Column:
    return F.regexp_extract(key, r"(?s)^(.*)#plural\.([^#]+)$", 2)


def array_base(key: Column) -> Column:
    return F.regexp_extract(key, r"(?s)^(.*)#array\.([0-9]+)$", 1)


def array_index(key: Column) -> Column:
    return F.regexp_extract(key, r"(?s)^(.*)#array\.([0-9]+)$", 2).try_cast("int")


def base_key(key: Column) -> Column:
    return F.coalesce(F.nullif(plural_base(key), F.lit("")), F.nullif(array_base(key), F.lit("")), key)


def is_locale(tag: Column) -> Column:
    return tag.rlike(r"^[a-z]{2,3}([-_]([A-Z][a-z]{3}|[A-Z]{2}|[0-9]{3})){0,2}$")


def android_qualifier(tag: Column) -> Column:
    """pt-BR -> pt-rBR, sr-Latn -> b+sr+Latn."""
    parts = F.split(tag, "[-_]")
    return (
        F.when(F.size(parts) == 1, tag)
        .when((F.size(parts) == 2) & F.get(parts, F.lit(1)).rlike("^([A-Z]{2}|[0-9]{3})$"), F.concat(F.get(parts, F.lit(0)), F.lit("-r"), F.get(parts, F.lit(1))))
        .otherwise(F.concat(F.lit("b+"), F.array_join(parts, "+")))
    )


def skip_directive(comment: Column, tool: str) -> Column:
    return comment.rlike(rf"(^|[\s,]){tool}:skip($|[\s,])")


def max_directive(comment: Column, tool: str) -> Column:
    return F.regexp_extract(comment, rf"{tool}:max=([0-9]+)", 1).try_cast("int")


def ignore_directive(comment: Column, tool: str) -> Column:
    found = F.regexp_extract(comment, rf"{tool}:ignore=([a-z]+(?:,[a-z]+)*)", 1)
    return F.filter(F.split(found, ","), lambda x: x != "")


# ---- similarity, hashing ---------------------------------------------------------------------------------------------


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 32)


def tokens(c: Column) -> Column:
    """Lower-case words of at least two bytes with a letter, without stop words, each once."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.octet_length(w) >= 2) & w.rlike(r"\p{L}") & ~w.isin(STOPWORDS)))


def similarity(a: Column, b: Column, ta: Column, tb: Column) -> Column:
    """Jaccard of tokens less a two-hundredth for each byte of difference in length."""
    return F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb)) - F.abs(F.octet_length(a) - F.octet_length(b)) / 200


def common_prefix(a: Column, b: Column) -> Column:
    """Length of what two strings have in common at their start."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda k: F.substr(a, F.lit(1), k) == F.substr(b, F.lit(1), k))
    return F.array_max(same)


def inflection(a: Column, b: Column) -> Column:
    shorter = F.least(F.length(a), F.length(b))
    return (common_prefix(a, b) >= 3) & (common_prefix(a, b) + 2 >= shorter) & (F.abs(F.length(a) - F.length(b)) <= 2)


def collapsed(c: Column) -> Column:
    return F.regexp_replace(trimmed(c), r"[\s\p{Z}]+", " ")


def count_optional(locale: Column, category: Column) -> Column:
    """A plural form that names an exact count may leave the count out, unless its language's `one` covers 21 too."""
    return category.isin("zero", "one", "two") & ~language(locale).isin(sorted(COUNT_MANDATORY))


def _looked_up(values: dict[str, str], c: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[c]


def flag(locale: Column) -> Column:
    """The flag of a locale's region, else of the country that stands for its language, else a globe."""
    from .. import dims

    parts = F.split(locale, "[-_]")
    region = F.get(F.filter(F.slice(parts, 2, F.size(parts)), lambda p: p.rlike("^[A-Za-z]{2}$")), F.lit(0))
    country = F.coalesce(F.upper(region), _looked_up(dims.FLAG_OF, F.lower(parts[0])))
    letter = {chr(65 + k): chr(0x1F1E6 + k) for k in range(26)}
    return F.when(country.isNull(), "🌐").otherwise(F.concat(_looked_up(letter, F.substr(country, F.lit(1), F.lit(1))), _looked_up(letter, F.substr(country, F.lit(2), F.lit(1)))))


def locale_name(tag: Column) -> Column:
    """A language's name, with what the region adds, and the tag; a tag of no known language is its own name."""
    from .. import dims

    parts = F.split(F.lower(tag), "[-_]")
    name, last = _looked_up(dims.LANGUAGE_NAMES, parts[0]), F.element_at(parts, -1)
    more = F.when(F.size(parts) > 1, _looked_up(dims.QUALIFIERS, F.concat_ws("-", parts[0], last)))
    return F.when(name.isNull(), tag).otherwise(F.concat(name, F.when(more.isNotNull(), F.concat(F.lit(" ("), more, F.lit(")"))).otherwise(""), F.lit(" ("), tag, F.lit(")")))


def latin_letters(c: Column) -> Column:
    """How many letters of the Latin script up to U+024F a text has."""
    return F.length(c) - F.length(F.regexp_replace(c, "[A-Za-zÀ-ɏ]", ""))


def lost_links(source: Column, translation: Column) -> Column:
    """Links of the source that the translation lacks, each once."""
    return F.array_except(links(source), links(translation))


def locale_suffix(stem: Column) -> Column:
    """prefix, locale of a file's stem: split at the first `_`, `-` or `.` whose tail is a locale; null locale if none."""
    parts = F.regexp_extract_all(stem, F.lit(r"[_.-]?[^_.-]+"), F.lit(0))
    at = F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2)))
    tails = F.transform(at, lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k - 1), "").alias("prefix"), F.regexp_replace(F.array_join(F.slice(parts, k, F.size(parts)), ""), "^[_.-]", "").alias("locale")))
    return F.coalesce(F.get(F.filter(tails, lambda x: is_locale(x["locale"])), F.lit(0)), F.struct(stem.alias("prefix"), F.lit(None).cast("string").alias("locale")))
