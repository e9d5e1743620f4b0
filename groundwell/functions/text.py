"""Text expressions: paths, slugs, links, titles, snippets and query terms; Catalyst expressions but for an injected tokenizer."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space (any Unicode kind) at both ends."""
    return F.regexp_replace(_col(x), r"(?U)^\s+|\s+$", "")


def normalize_path(x: Column | str) -> Column:
    """POSIX form: stripped, forward slashes, no empty or ``.`` parts; ``..`` stays, empty is ``.``, just two leading slashes stay two."""
    path = F.translate(strip(x), "\\", "/")
    parts = F.array_join(F.filter(F.split(path, "/"), lambda p: (p != "") & (p != ".")), "/")
    root = F.when(path.rlike("^//(?!/)"), "//").when(path.startswith("/"), "/").otherwise("")
    whole = F.concat(root, parts)
    return F.when(whole == "", ".").otherwise(whole)


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def stem(path: Column | str) -> Column:
    """File name without its last suffix; a name that only starts with a dot has none."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def suffix(path: Column | str) -> Column:
    """Lower-cased last suffix with its dot, or empty."""
    return F.lower(F.regexp_extract(file_name(path), r"(?<=.)(\.[^.]+)$", 1))


def title_case(x: Column | str) -> Column:
    """Each run of letters with a capital first and small letters after, whatever separates the runs; a letter whose capital is two gives one and a small one."""
    pieces = F.regexp_extract_all(_col(x), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    first = lambda p: F.upper(F.left(p, F.lit(1)))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.left(first(p), F.lit(1)), F.lower(F.substring(first(p), 2, 8)), F.lower(F.substring(p, 2, 1 << 30)))), "")


def slugify(title: Column | str) -> Column:
    """Lower case, every run of other characters than letters and digits as one dash, at most 40 characters, never empty."""
    dashed = F.regexp_replace(F.lower(_col(title)), r"[^\p{L}\p{N}]+", "-")
    slug = F.left(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit(40))
    return F.when(F.coalesce(slug, F.lit("")) == "", "page").otherwise(slug)


def note_file_name(title: Column | str) -> Column:
    return F.concat(F.replace(F.lower(_col(title)), F.lit(" "), F.lit("-")), F.lit(".md"))


def wikilinks(body: Column | str) -> Column:
    """What stands between double brackets, in order."""
    return F.regexp_extract_all(_col(body), F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))


def link_target(link: Column | str) -> Column:
    """A link without its alias and anchor."""
    return strip(F.split_part(F.split_part(_col(link), F.lit("|"), F.lit(1)), F.lit("#"), F.lit(1)))


def snippet(text: Column | str, size: int = 200) -> Column:
    return F.when(F.length(_col(text)) > size, F.concat(F.left(_col(text), F.lit(size)), F.lit("..."))).otherwise(_col(text))


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_terms(query: Column | str) -> Column:
    """White-space separated terms without quotes; terms that are then empty go."""
    return F.filter(F.split(strip(F.translate(_col(query), "\"'", "")), r"(?U)\s+"), lambda t: t != "")


def context_header(title: Column | str, uri: Column | str, loc: Column | str) -> Column:
    return F.format_string("[Document: %s | Source: %s | Context: %s]", _col(title), _col(uri), _col(loc))


def contextual_text(header: Column | str, text: Column | str) -> Column:
    return F.when(_col(header) != "", F.concat(_col(header), F.lit("\n\n"), _col(text))).otherwise(_col(text))


def content_hash(summary: Column | str, entities: Column | str) -> Column:
    """SHA-256 of the summary and the sorted entities."""
    return F.sha2(F.concat_ws("::", _col(summary), F.array_join(F.array_sort(_col(entities)), ",")), 256)


def yaml_scalar(x: Column | str) -> Column:
    """A value as a YAML scalar: plain where that reads back as the same text, else in double quotes."""
    value = _col(x)
    plain = value.rlike(r"^[\p{L}][\p{L}\p{N} _./,()-]*$") & ~value.endswith(" ") & ~F.lower(value).isin("true", "false", "yes", "no", "on", "off", "null", "y", "n")
    quoted = F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.when(plain, value).otherwise(F.concat(F.lit('"'), quoted, F.lit('"')))


def source_block(path: Column | str, hint: Column | str, loc: Column | str) -> Column:
    """An address as an item of a page's list of sources."""
    has_loc = F.coalesce(_col(loc), F.lit("")) != ""
    return F.concat(F.lit("  - path: "), _col(path), F.lit("\n    hint: "), _col(hint), F.when(has_loc, F.concat(F.lit("\n    loc: "), _col(loc))).otherwise(F.lit("")), F.lit("\n"))


def full_text(sections: Column | str) -> Column:
    """Texts of sections that are not blank, with an empty line between them."""
    return F.array_join(F.filter(F.transform(_col(sections), lambda s: s["text"]), lambda t: strip(t) != ""), "\n\n")


def departments(csv: Column | str) -> Column:
    """A comma list as an array; empty is null, so that overlaps with it are not true."""
    return F.split(F.nullif(_col(csv), F.lit("")), ",")


def string_map(json: Column | str) -> Column:
    """A JSON object with all values as text; anything else is an empty map."""
    return F.coalesce(F.from_json(_col(json), "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def merge_maps(first: Column, second: Column) -> Column:
    """Both maps; where they share a key, the second's value."""
    keys = F.map_keys(second)
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.array_contains(keys, k)), second)


def tokens_per_second(completion: Column, latency_ms: Column) -> Column:
    """The generated column of telemetry: tokens by seconds, 0 without a latency, to two places as a decimal.

    Tiny latencies give rates beyond ten digits, so the decimal is as wide as can be; a rate that is no number or fits none is null.
    """
    return F.when(latency_ms > 0, F.round(F.try_divide(completion, latency_ms / 1000), 2)).otherwise(0).try_cast("decimal(38,2)")


def token_count(text: Column | str, encode: Callable[[str], list[int]] | None = None, encode_batch: Callable[[list[str]], list] | None = None) -> Column:
    """Number of tokens: words between white space, or what a tokenizer makes of each text: its function for one text, or for the texts of an Arrow batch at a time."""
    if encode is None and encode_batch is None:
        return F.size(F.filter(F.split(_col(text), r"\s+"), lambda x: x != "")).cast("bigint")
    batch = encode_batch or (lambda texts: [encode(t) for t in texts])

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(x) for x in batch(texts.fillna("").tolist())], dtype="int64")

    return count(_col(text))
