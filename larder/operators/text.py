"""Text filters, slugs, links and recipe data of crawled pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def strip_accents(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility decomposition without combining marks; d with stroke stays.  Spark has no such function, so Arrow batches go to Python."""
    import unicodedata

    def bare(s: str | None) -> str | None:
        if s is None or s.isascii():
            return s
        return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))

    for s in batches:
        yield s.map(bare, na_action="ignore")


def text_key(c: Column) -> Column:
    return F.lower(strip_accents(c))


def safe_slug(c: Column, max_len: int = 80) -> Column:
    """Lower-case ASCII words joined by _, at most max_len characters; 'item' if nothing is left or the text is null."""
    key = F.lower(strip_accents(F.translate(F.coalesce(c, F.lit("")), "đĐ", "dD")))
    bare = F.regexp_replace(F.regexp_replace(key, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.regexp_replace(F.substring(F.when(bare == "", "item").otherwise(bare), 1, max_len), r"_+$", "")


def safe_label(c: Column, default: str = "item") -> Column:
    """Each character other than letters, digits, _ and - as _; the default if blank or null."""
    out = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_\-]", "_")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(default))


def pair_folder(*parts: Column) -> Column:
    """The non-empty parts joined by __, slashes and blanks in them as _."""
    return F.concat_ws("__", *[F.nullif(F.regexp_replace(p, r"[/\\ ]", "_"), F.lit("")) for p in parts])


def _quoted(term: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in term)


def term_present(text: Column, key: Column, term: str, folded_term: str, *, sensitive: bool) -> Column:
    """Whether a term occurs: with a blank in it anywhere, else as a whole word; accents count only for sensitive terms.

    text: in lower case; key: in lower case without accents.
    """
    if " " in term:
        return text.contains(term) if sensitive else key.contains(folded_term)
    if sensitive:
        return text.rlike(rf"(?U)(?<!\w){_quoted(term)}(?!\w)")
    return key.rlike(rf"(?<![a-z0-9]){_quoted(folded_term)}(?![a-z0-9])")


def text_filter(rows: DataFrame, text: str, *, positive: list[str], negative: list[str], sensitive: set[str] = frozenset()) -> DataFrame:
    """All rows with ``accepted`` and ``reason``: any negative term rejects, else one positive is needed; up to eight positives are named.

    A null text is an empty one.
    """
    from unicodedata import combining, normalize

    def bare(term: str) -> str:
        return "".join(c for c in normalize("NFKD", term) if not combining(c)).lower()

    d = rows.withColumn("_larder_text", F.lower(F.coalesce(F.col(text), F.lit("")))).withColumn("_larder_key", text_key(F.coalesce(F.col(text), F.lit(""))))
    found = lambda terms: F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(term_present(F.col("_larder_text"), F.col("_larder_key"), t.lower(), bare(t), sensitive=t in sensitive), t) for t in terms] or [F.lit(None).cast("string")]))))
    d = d.withColumn("_larder_neg", found(negative)).withColumn("_larder_pos", found(positive))
    reason = F.when(F.size("_larder_neg") > 0, F.concat(F.lit("negative_text:"), F.concat_ws("|", "_larder_neg"))).when(F.size("_larder_pos") == 0, "missing_positive_text")
    reason = reason.otherwise(F.concat(F.lit("text_ok:"), F.concat_ws("|", F.slice("_larder_pos", 1, 8))))
    return d.withColumn("accepted", (F.size("_larder_neg") == 0) & (F.size("_larder_pos") > 0)).withColumn("reason", reason).drop("_larder_text", "_larder_key", "_larder_neg", "_larder_pos")


def page_links(html: Column, base: str, path_pattern: str) -> Column:
    """Distinct sorted addresses of links whose target holds the pattern, queries cut off, relative ones completed."""
    hrefs = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    wanted = F.filter(hrefs, lambda h: h.rlike(path_pattern))
    root = base.split("//", 1)[0] + "//" + base.split("//", 1)[1].split("/", 1)[0]

    def whole(h: Column) -> Column:
        bare = F.split_part(h, F.lit("?"), F.lit(1))
        return F.when(bare.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"), bare).when(bare.startswith("//"), F.concat(F.lit(base.split("//", 1)[0]), bare)).when(bare.startswith("/"), F.concat(F.lit(root), bare)).otherwise(F.concat(F.lit(base.rsplit("/", 1)[0] + "/"), bare))

    return F.array_sort(F.array_distinct(F.transform(wanted, whole)))


def recipe_of_page(html: Column) -> Column:
    """struct(title, image_url, text) of the first JSON-LD block that is a recipe, null without one, a title or a picture.

    text: title, description, keywords, ingredients and steps.  A broken block is passed
    over; a list of pictures gives its first.
    """
    blocks = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    schema = "`@type` string, name string, image string, description string, keywords string, recipeIngredient array<string>, recipeInstructions array<struct<text:string>>"
    parsed = F.transform(blocks, lambda b: F.from_json(F.trim(b), schema, {"mode": "PERMISSIVE"}))
    r = F.try_element_at(F.filter(parsed, lambda p: p["@type"] == "Recipe"), F.lit(1))
    listed = F.from_json(r["image"], "array<string>")
    image = F.trim(F.coalesce(F.when(r["image"].startswith("["), F.coalesce(F.try_element_at(listed, F.lit(1)), F.lit(""))).otherwise(r["image"]), F.lit("")))
    title = F.trim(F.coalesce(r["name"], F.lit("")))
    none = F.array().cast("array<string>")
    steps = F.transform(r["recipeInstructions"], lambda s: F.coalesce(s["text"], F.lit("")))
    parts = F.concat(F.array(title, F.coalesce(r["description"], F.lit("")), F.coalesce(r["keywords"], F.lit(""))), F.coalesce(r["recipeIngredient"], none), F.coalesce(steps, none))
    return F.when((title != "") & (image != ""), F.struct(title.alias("title"), image.alias("image_url"), F.concat_ws(" ", parts).alias("text")))


def search_address(base: str, query: Column, page: Column) -> Column:
    """base/<quoted query>, and ?page= from page two on."""
    quoted = F.replace(F.replace(F.url_encode(query), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    return F.concat(F.lit(base.rstrip("/") + "/"), quoted, F.when(page > 1, F.concat(F.lit("?page="), page.cast("string"))).otherwise(""))


def data_url_bytes(url: Column) -> Column:
    """The bytes of a base64 data address, or of bare base64; null if unreadable."""
    return F.try_to_binary(F.element_at(F.split(url, ","), -1), F.lit("base64"))
