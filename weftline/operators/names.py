"""Names of a site grouped in order, in rounds over an index of their words.

A name joins the first group whose leader has all of its words, or only words of it, or shares a telling word (three letters or
more, not a number) with it; a name that matches no earlier leader leads a group. What leads depends on all earlier names, but
not on their number: a name whose earlier likes are all decided is decided, so in each round every name that is the first
undecided one under all of its words leads, all at once, and all that are like it are no leaders.

Names are never paired. Under a telling word only the first undecided name and the first leader count, which are aggregates of
(site, word). If one name's words lie within another's and no telling word is shared, the smaller one has no telling words; so
only the distinct sets of such short words are compared, through one of their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from ..sources.pages import first_by
from ..sources.scratch import written
from . import checks


def telling(words: Column) -> Column:
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.rlike("^[0-9]+$"))


def _keys(names: DataFrame) -> DataFrame:
    """(site, ord, key, own) of names (site, ord, words): the keys under which a name meets others. Telling words are keys of
    their own. Every set of only short words that is a name is a key; the names that have all of its words are under it."""
    words = names.select("site", "ord", F.explode(telling(F.col("words"))).alias("w")).select("site", "ord", F.concat(F.lit("w "), "w").alias("key"))
    short = names.withColumn("short", F.array_sort(F.array_except("words", telling(F.col("words")))))
    sets = short.filter(F.size(telling(F.col("words"))) == 0).select("site", F.col("short").alias("small")).distinct()
    sets = sets.withColumn("w", F.get("small", F.lit(0)))
    larger = short.filter(F.size("short") > 0).select("site", F.col("short").alias("large")).distinct().select("site", "large", F.explode("large").alias("w"))
    within = larger.join(sets, ["site", "w"]).filter(F.size(F.array_except("small", "large")) == 0).select("site", F.col("large").alias("short"), "small")
    under = short.join(within, ["site", "short"]).select("site", "ord", F.concat(F.lit("s "), F.array_join("small", " ")).alias("key"), (F.col("small") == F.col("short")) & (F.size(telling(F.col("words"))) == 0))
    under = under.toDF("site", "ord", "key", "own")
    # Two large names under one small set are not alike by it; one of the two must be the small name itself.
    return words.withColumn("own", F.lit(True)).unionByName(under)


def leaders(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(led, keys): led (site, ord) of names (site, ord, words) that lead groups, and the keys of all names."""
    keys = written(_keys(names), "name_keys")
    state = written(names.select("site", "ord", F.lit(None).cast("boolean").alias("leads")), "name_state")
    while not state.filter("leads IS NULL").isEmpty():
        # Names under a key that count for others there: all of them for the small name itself, itself for all.
        at = keys.join(state, ["site", "ord"])
        by_key = at.groupBy("site", "key").agg(
            F.min(F.when(F.col("leads").isNull(), F.col("ord"))).alias("open"),
            F.min(F.when(F.col("leads").isNull() & F.col("own"), F.col("ord"))).alias("own_open"),
            F.min(F.when(F.col("leads"), F.col("ord"))).alias("led"),
            F.min(F.when(F.col("leads") & F.col("own"), F.col("ord"))).alias("own_led"),
        )
        seen = at.filter("leads IS NULL").join(by_key, ["site", "key"])
        first = F.when(F.col("own"), F.col("open")).otherwise(F.col("own_open"))
        led = F.when(F.col("own"), F.col("led")).otherwise(F.col("own_led"))
        # An earlier leader decides; without one, a name leads when no earlier like is open.
        verdict = seen.groupBy("site", "ord").agg(F.bool_or(led < F.col("ord")).alias("joins"), F.bool_or(first < F.col("ord")).alias("waits"))
        now = F.when(F.col("joins"), False).when(~F.coalesce("waits", F.lit(False)), True)
        state = written(state.join(verdict, ["site", "ord"], "left").select("site", "ord", F.coalesce("leads", F.when(F.col("leads").isNull(), now)).alias("leads")), "name_state")
    return state.filter("leads").select("site", "ord"), keys


def name_groups(names: DataFrame) -> DataFrame:
    """(site, name, leader) of names (site, ord, name, words): each distinct name with words, and the name that leads its group.

    ord tells a site's names apart and orders them; of equal names the first counts. Names without words are left out."""
    once = first_by(names.filter(F.size("words") > 0), ["site", "name"], ["ord"])
    once = written(once.select("site", "ord", "name", F.array_distinct("words").alias("words")), "names")
    led, keys = leaders(once)
    heads = keys.join(led, ["site", "ord"])
    by_key = heads.groupBy("site", "key").agg(F.min("ord").alias("any_led"), F.min(F.when(F.col("own"), F.col("ord"))).alias("own_led"))
    met = keys.join(by_key, ["site", "key"]).withColumn("led", F.when(F.col("own"), F.col("any_led")).otherwise(F.col("own_led")))
    first = met.groupBy("site", "ord").agg(F.min("led").alias("led"))
    named = once.join(first, ["site", "ord"]).select("site", "name", "led")
    return named.join(once.select("site", F.col("ord").alias("led"), F.col("name").alias("leader")), ["site", "led"]).select("site", "name", "leader")


# ---- what names say of a site ---------------------------------------------------------------------------------------

ANCHORED = ("og", "schema", "footer")  # surfaces that state a name, not a topic
_OG = r"(?is)<meta(?=[^>]*\sproperty\s*=\s*[\"']og:site_name[\"'])[^>]*\scontent\s*=\s*[\"']([^\"']*)"


def site_names(pages: DataFrame, footer: Column, schema: DataFrame | None = None) -> DataFrame:
    """(site, ord, surface, name, words) of pages (site, page_id, url, path, html): what the Open Graph site name, JSON-LD, the
    footer and, on home pages, the parts of the title call the site, in this order on each page and in order of pages.

    footer: the name in a page's footer; schema (site, url, nth, name): names of its JSON-LD."""
    title = texts.title_segments(F.regexp_extract("html", "(?is)<title[^>]*>([^<]*)</title>", 1))
    home = F.regexp_replace("path", "/+$", "") == ""
    one = lambda surface, name: F.transform(F.filter(F.array(F.nullif(F.trim(name), F.lit(""))), lambda n: n.isNotNull()), lambda n: F.struct(F.lit(surface).alias("surface"), n.alias("name")))
    titles = F.transform(F.when(home, title).otherwise(F.array().cast("array<string>")), lambda n: F.struct(F.lit("title").alias("surface"), n.alias("name")))
    own = F.concat(one("og", F.regexp_extract("html", _OG, 1)), one("footer", footer), titles)
    rows = pages.select("site", "page_id", F.posexplode(own).alias("nth", "n"))
    rows = rows.select("site", F.struct("page_id", F.when(F.col("n.surface") == "og", 0).otherwise(2).alias("kind"), F.col("nth").cast("long").alias("nth")).alias("ord"), "n.surface", "n.name")
    if schema is not None:
        named = schema.join(pages.select("site", "url", "page_id"), ["site", "url"])
        said = named.select("site", F.struct("page_id", F.lit(1).alias("kind"), F.col("nth").cast("long").alias("nth")).alias("ord"), F.lit("schema").alias("surface"), "name")
        rows = rows.unionByName(said)
    return rows.withColumn("words", texts.name_tokens(F.col("name")))


def variants(names: DataFrame) -> DataFrame:
    """(site, leader, first, mentions, anchored, schema) of names (site, ord, surface, name, words): a row for each group; first
    is the place of its first name; anchored and schema tell whether a surface that states a name, or JSON-LD, names it so."""
    once = names.filter(F.size("words") > 0).select("site", "ord", "surface", "name")
    rows = once.join(name_groups(names), ["site", "name"])
    return rows.groupBy("site", "leader").agg(
        F.min("ord").alias("first"), F.count(F.lit(1)).alias("mentions"), F.bool_or(F.col("surface").isin(*ANCHORED)).alias("anchored"), F.bool_or(F.col("surface") == "schema").alias("schema")
    )


def inconsistent(sites: DataFrame, groups: DataFrame) -> DataFrame:
    """ENT-NAME-INCONSISTENT: what a judgment starts from; the gate passes. sites: (site); groups: of variants()."""
    per = groups.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.count_if("anchored").alias("anchored"))
    rows = sites.select("site").distinct().join(per, "site", "left").fillna(0, ["n", "anchored"])
    return checks.result(rows, "ENT-NAME-INCONSISTENT", F.lit(checks.PASSED), "low", "low", F.format_string("%d variants of the name, %d stated as such", "n", "anchored"))


def schema_conflict(names: DataFrame, groups: DataFrame) -> DataFrame:
    """(site, schema_name, visible_name) of sites with two groups of names at most, whose first name in JSON-LD shares no group of
    words with any title or Open Graph name: neither has all words of the other."""
    few = groups.groupBy("site").agg(F.count(F.lit(1)).alias("n")).filter("n <= 2").select("site")
    worded = names.filter(F.size("words") > 0).join(few, "site")
    said = first_by(worded.filter("surface = 'schema'"), ["site"], ["ord"]).select("site", F.col("name").alias("schema_name"), F.col("words").alias("w"))
    seen = worded.filter(F.col("surface").isin("title", "og")).join(said, "site")
    like = (F.size(F.array_except("w", "words")) == 0) | (F.size(F.array_except("words", "w")) == 0)
    per = seen.groupBy("site", "schema_name").agg(F.bool_or(like).alias("like"), F.min_by("name", "ord").alias("visible_name"))
    return per.filter(~F.col("like")).select("site", "schema_name", "visible_name")
