"""robots.txt: parsing to rules, and the longest matching rule of a token for a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse(files: DataFrame) -> DataFrame:
    """(site, grp, token, kind, rule, ord) from (site, body). A group is its run of user-agent lines and the rules below.

    The group number counts the user-agent lines that follow a rule; comments and empty rules are left out. A group
    without rules is one row of null kind and rule for each of its agents: they may read all."""
    lines = files.select("site", F.posexplode(F.split("body", "\r?\n")).alias("ord", "raw"))
    clean = F.trim(F.regexp_replace("raw", "#.*$", ""))
    lines = lines.select("site", "ord", F.lower(F.trim(F.regexp_extract(clean, "^([^:]*):", 1))).alias("field"), F.trim(F.regexp_extract(clean, "^[^:]*:(.*)$", 1)).alias("value"))
    lines = lines.filter(F.col("field").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("site").orderBy("ord")
    begins = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")
    lines = lines.withColumn("grp", F.sum(begins.cast("int")).over(order))
    agents = lines.filter("field = 'user-agent'").select("site", "grp", F.lower("value").alias("token"))
    rules = lines.filter("field <> 'user-agent' and value <> ''").select("site", "grp", F.col("field").alias("kind"), F.col("value").alias("rule"), "ord")
    return agents.join(rules, ["site", "grp"], "left").select("site", "grp", "token", "kind", "rule", "ord")


def effective(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """(site, token, kind, rule, ord) that holds for each of tokens (token): its own group, or else that of *."""
    wanted = tokens.select(F.lower("token").alias("token"))
    own = rules.join(F.broadcast(wanted), "token").select("site", "token", "kind", "rule", "ord")
    rest = rules.select("site").distinct().crossJoin(F.broadcast(wanted)).join(own.select("site", "token").distinct(), ["site", "token"], "left_anti")
    star = rules.filter("token = '*'").select("site", "kind", "rule", "ord")
    return own.unionByName(rest.join(star, "site").select("site", "token", "kind", "rule", "ord"))


def matches(path: Column, rule: Column) -> Column:
    """Whether a rule begins a path: stars at its end stand for anything, a dollar sign there asks for the whole path.
    Stars inside a rule never match, so that fewer paths are reported."""
    whole = path == F.substring(rule, F.lit(1), F.length(rule) - 1)
    return F.when(rule.endswith("$"), whole).otherwise(path.startswith(F.rtrim(rule, F.lit("*"))))


def decide(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(site, token, path, rule, blocked) of paths (site, path) under rules (site, token, kind, rule, ord).

    The longest rule that matches the path decides, its length without stars and the dollar sign at its end; of equally
    long ones a disallow, then the first."""
    size = F.length(F.rtrim("rule", F.lit("*$")))
    rank = F.when(matches(F.col("path"), F.col("rule")), F.struct(size, (F.col("kind") == "disallow").cast("int"), -F.col("ord")))
    best = paths.join(rules, "site").groupBy("site", "token", "path").agg(F.max_by(F.struct("rule", "kind"), rank).alias("best"))
    return best.select("site", "token", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.kind") == "disallow", F.lit(False)).alias("blocked"))
