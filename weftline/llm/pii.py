"""Personal data in texts: candidate spans chosen by boosted trees, with DataFrame functions only.

Base spans follow fixed patterns and checks (BASE) and always stay. Beyond them, high-recall generators (GENERATORS) propose
spans that may overlap. Each has features of its format and context, small whole numbers, and boosted trees score it. They
learn from the texts themselves: a candidate that is about a base span is personal data, one that meets none is not, and
from each base span variants in other forms are made, with a label each (_variants). Texts of one half, by hash, teach the
trees; the other half sets for each family of spans the least score from which PRECISION of the candidates are right.
Chosen candidates that overlap are one span; those that meet a base span add nothing.

Candidates are counted by features before they teach, so trees grow by aggregating a table of distinct features, a job for
each level; only sums by node, feature and value come to the driver. Patterns are possessive and begin at the first character
of a run, so they take time in proportion to the text; positions come from sums in two levels.

Null texts count as empty and have no spans. Repeated rows stay and teach as often as they are there. Where a table has no
base spans or nothing but them, nothing is learned and no span is added.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

TREES, DEPTH, RATE, LAMBDA = 12, 3, 0.4, 1.0
PRECISION = 0.95
FEW = 200_000  # distinct features that one task can hold while trees grow; more are aggregated in many
_STEP = 64  # places that a sum in two levels takes together
_LEFT, _RIGHT = 24, 8  # characters of context

_LOCAL = "[A-Za-z0-9._%+-]"
#: Kinds in the order of the result. The patterns are the described ones; `\G` and the look-behind keep a search from
#: beginning within a run that it could only fail on.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:@|\x20?[(\[{]\x20?(?:at|AT|@)\x20?[)\]}]\x20?|\x20at\x20)"
_DOT = r"(?:\.|\x20?[(\[{]\x20?(?:dot|DOT|\.)\x20?[)\]}]\x20?|\x20dot\x20)"
#: name: (family, pattern)
GENERATORS = {
    "address": ("mail", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++"),
    "dotted": ("net", rf"(?<![0-9])[0-9]{{1,3}}+(?:{_DOT}[0-9]{{1,3}}+){{3}}+(?![0-9])"),
    "chain": ("number", r"(?<![0-9])[+(]{0,2}+[0-9]++(?:[\x20()./_-]{1,3}+[0-9]++)*+"),
    "run": ("number", r"(?<![0-9])[0-9]{9,19}+(?![0-9])"),
    "fours": ("number", r"(?<![0-9])[0-9]{4}([\x20._/-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
    "area": ("number", r"(?<![0-9])\(?[0-9]{2,5}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-]?[0-9]{3,6}(?![0-9])"),
}
FAMILIES = ("mail", "net", "number")
LEAST_DIGITS, MOST_DIGITS = 7, 40  # of a number's candidate
_CUES = r"(?i)(mail|courriel|correo|phone|tel|fon|call|mobil|fax|handy|contact|kontakt|card|karte|carte|tarjeta|visa|konto|host|address|adress|direcci)"
_COUNTER = r"(?i)(version|isbn|issn|doi|order|bestell|commande|pedido|page|seite|licen|rfc|invoice|rechnung|\x24|\x{20AC}|usd|eur|fig)"
_COMMON_ENDS = r"(?i)(com|org|net|edu|gov|info|io|de|fr|es|uk|eu|ch|at)$"

# ---- places ---------------------------------------------------------------------------------------------------------


def _running(rows: DataFrame, of: dict[str, str], merge, zero: int) -> DataFrame:
    """rows with columns named by `of`: running results of merge over the array columns that it names.

    Arrays are taken in steps, and the results of the steps once more, so no place looks at all places before it."""

    def within(array):
        last = F.greatest(F.lit(0), F.floor((F.size(array) - 1) / _STEP).cast("int"))
        parts = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(array, b * _STEP + 1, F.lit(_STEP)))
        return F.transform(parts, lambda s: F.transform(s, lambda _, i: F.aggregate(F.slice(s, F.lit(1), i + 1), F.lit(zero).cast("long"), merge)))

    rows = rows.withColumns({f"_{n}": within(a) for n, a in of.items()})

    def before(n):
        done = F.col(f"_{n}")
        return F.transform(done, lambda _, j: F.aggregate(F.slice(done, F.lit(1), j), F.lit(zero).cast("long"), lambda acc, s: merge(acc, F.element_at(s, -1))))

    rows = rows.withColumns({f"_{n}_before": before(n) for n in of})
    done = {n: F.flatten(F.zip_with(f"_{n}", f"_{n}_before", lambda s, o: F.transform(s, lambda x: merge(x, o)))) for n in of}
    return rows.withColumns(done).drop(*[f"_{n}" for n in of], *[f"_{n}_before" for n in of])


def _add(x: Column, y: Column) -> Column:
    return x + y


def _larger(x: Column, y: Column) -> Column:
    return F.greatest(x, y)


def _matches(rows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """rows (with a column t) and for each pattern a column of its matches: array of (start, end, text, left, right)."""
    t = F.col("t")
    found, gaps = {}, {}
    for name, pattern in patterns.items():
        there = F.contains(t, F.lit("@")) if name == "email" else F.lit(True) if name == "address" else t.rlike("[0-9]")
        none = F.array().cast("array<string>")
        found[f"{name}_m"] = F.when(there, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none)
        ends = lambda g: F.struct(F.length(g).cast("long").alias("n"), F.right(g, F.lit(_LEFT)).alias("left"), F.left(g, F.lit(_RIGHT)).alias("right"))
        gaps[f"{name}_g"] = F.when(there, F.transform(F.split(t, pattern, -1), ends))
    rows = rows.withColumns(found)
    rows = rows.withColumns({n: F.when(F.size(f"{n[:-2]}_m") > 0, g) for n, g in gaps.items()})

    def steps(name):
        m, g = F.col(f"{name}_m"), F.col(f"{name}_g")
        return F.transform(m, lambda _, i: F.get(g, i)["n"] + F.when(i > 0, F.length(F.get(m, i - 1)).cast("long")).otherwise(0))

    rows = rows.withColumns({f"{n}_s": steps(n) for n in patterns})
    rows = _running(rows, {f"{n}_at": f"{n}_s" for n in patterns}, _add, 0)

    def spans(name):
        m, g, at = F.col(f"{name}_m"), F.col(f"{name}_g"), F.col(f"{name}_at")
        return F.transform(
            m,
            lambda x, i: F.struct(
                F.get(at, i).alias("start"),
                (F.get(at, i) + F.length(x)).alias("end"),
                x.alias("text"),
                F.get(g, i)["left"].alias("left"),
                F.get(g, i + 1)["right"].alias("right"),
            ),
        )

    rows = rows.withColumns({n: spans(n) for n in patterns})
    return rows.drop(*[f"{n}_{x}" for n in patterns for x in ("m", "g", "s", "at")])


# ---- checks and features --------------------------------------------------------------------------------------------


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid last digit by the Luhn sum."""

    def value(c, i):
        twice = c.try_cast("int") * 2
        return F.when(i % 2 == 0, c.try_cast("int")).when(twice > 9, twice - 9).otherwise(twice)

    values = F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), value)
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x) % 10 == 0


def _byte(part: Column) -> Column:
    """Whether a number of any length is at most 255."""
    short = F.ltrim(part, F.lit("0"))
    return (F.length(short) <= 3) & (F.concat(F.lit("0"), F.substring(short, 1, 3)).try_cast("int") <= 255)


def _valid(kind: str, span: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(span["text"], r"\."), _byte)
    digits = F.regexp_replace(span["text"], "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def _class(near: Column) -> Column:
    return F.when((near == "") | near.rlike(r"^\s"), 0).when(near.rlike("^[0-9]"), 2).when(near.rlike(r"^\p{L}"), 3).when(near == "+", 4).otherwise(1)


#: What the trees see of a candidate, in order; each a whole number of few values.
FEATURES = (
    "family", "digits", "runs", "longest", "first", "last", "lead", "luhn", "space", "dot", "hyphen", "bracket", "slash",
    "mark", "end", "letters", "large", "left", "right", "cue", "counter",
)


def _features(family: str, c: Column) -> Column:
    """c: a match with its digits and runs of digits."""
    t, digits, runs = c["text"], c["digits"], c["runs"]

    def has(pattern):
        return t.rlike(pattern).cast("int")

    def capped(n, most):
        return F.least(n, F.lit(most))

    longest = F.array_max(F.transform(runs, lambda r: F.length(r)))
    mark = F.when(F.contains(t, F.lit("@")), 1).when(t.rlike(r"[(\[{]\x20?(?:at|AT)"), 2).when(t.rlike(r"\x20at\x20"), 3).otherwise(0)
    found = {
        "family": F.lit(FAMILIES.index(family)),
        "digits": capped(F.length(digits), 24),
        "runs": capped(F.size(runs), 9),
        "longest": capped(longest, 20),
        "first": capped(F.length(F.get(runs, F.lit(0))), 10),
        "last": capped(F.length(F.element_at(runs, -1)), 10),
        "lead": F.coalesce(F.substring(digits, 1, 1).try_cast("int"), F.lit(10)),
        "luhn": F.when(~F.length(digits).between(12, 19), 0).when(luhn(digits), 2).otherwise(1),
        "space": has(r"\x20"),
        "dot": has(r"\."),
        "hyphen": has("[_-]"),
        "bracket": has(r"[()\[\]{}]"),
        "slash": has("/"),
        "mark": mark,
        "end": F.when(F.lit(family == "mail"), has(_COMMON_ENDS)).otherwise(0),
        "letters": capped(F.length(F.regexp_replace(t, r"[^A-Za-z]", "")), 24),
        "large": F.exists(runs, lambda r: (r != "") & ~_byte(r)).cast("int"),
        "left": _class(F.right(c["left"], F.lit(1))),
        "right": F.when(c["right"].rlike(r"^[.,/:-][0-9]"), 5).otherwise(_class(c["right"])),
        "cue": c["left"].rlike(_CUES).cast("int"),
        "counter": c["left"].rlike(_COUNTER).cast("int"),
    }
    return F.array(*[found[name].cast("int") for name in FEATURES])


def _candidates(rows: DataFrame) -> DataFrame:
    """rows (with a column t) and cands: array of (start, end, family, f), f as in FEATURES."""
    rows = _matches(rows, {n: pattern for n, (_, pattern) in GENERATORS.items()})

    def digits(c):
        return F.regexp_replace(c["text"], "[^0-9]", "")

    def seen(name):
        family = GENERATORS[name][0]
        runs = lambda c: F.split(F.btrim(F.regexp_replace(c["text"], "[^0-9]+", " ")), " ")
        spans = F.col(name)
        if family == "number":
            spans = F.filter(spans, lambda c: F.length(digits(c)).between(LEAST_DIGITS, MOST_DIGITS))
        spans = F.transform(spans, lambda c: c.withField("digits", digits(c)).withField("runs", runs(c)))
        return F.transform(spans, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(family).alias("family"), _features(family, c).alias("f")))

    return rows.withColumn("cands", F.concat(*map(seen, GENERATORS))).drop(*GENERATORS)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, half, base, cands) of each row: its key, the half of its text by hash, base spans (start, end, kind, text, left,
    right) by kind and start, and candidates."""
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    rows = _matches(rows.withColumn("half", F.pmod(F.xxhash64("t"), F.lit(2))), BASE)

    def valid(kind):
        return F.transform(F.filter(kind, lambda s: _valid(kind, s)), lambda s: s.withField("kind", F.lit(kind)))

    rows = rows.withColumn("base", F.concat(*map(valid, BASE))).drop(*BASE)
    return _candidates(rows).select("k", "half", "base", "cands")


# ---- learning -------------------------------------------------------------------------------------------------------


def _variants(span: Column) -> Column:
    """Other forms of a base span: array of (label, text)."""
    t, kind = span["text"], span["kind"]
    digits = F.regexp_replace(t, "[^0-9]", "")
    word = F.regexp_extract(span["left"], r"(\p{L}+)\P{L}*$", 1)
    form = lambda label, text: F.struct(F.lit(label).alias("label"), text.alias("text"))
    local, host = F.substring_index(t, "@", 1), F.substring_index(t, "@", -1)
    email = F.array(
        form(1, F.concat(local, F.lit(" at "), F.regexp_replace(host, r"\.", " dot "))),
        form(1, F.concat(local, F.lit(" (at) "), host)),
        form(1, F.concat(local, F.lit("[at]"), F.regexp_replace(host, r"\.", "[dot]"))),
        form(0, F.concat(word, F.lit(" at "), word, F.lit("."), word)),
        form(0, F.concat(word, F.lit(" at "), word, F.lit("."), F.initcap(word))),
    )
    ip = F.array(
        form(1, F.regexp_replace(t, r"\.", "[.]")),
        form(1, F.regexp_replace(t, r"\.", " dot ")),
        form(0, F.concat(t, F.lit("."), F.substring_index(t, ".", 1))),
        form(0, F.regexp_replace(t, r"^[0-9]+", "999")),
    )
    wrong = F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), ((F.right(digits, F.lit(1)).try_cast("int") + 3) % 10).cast("string"))
    fours = lambda d, mark: F.regexp_replace(d, r"([0-9]{4})(?=[0-9])", f"$1{mark}")
    card = F.array(*[form(y, fours(d, mark)) for y, d in ((1, digits), (0, wrong)) for mark in (".", "/", "_", " ")], form(1, digits), form(0, wrong))
    at = lambda i, n: F.substring(digits, i, n)
    phone = F.array(
        form(1, F.substring(t, F.lit(2), F.length(t))),
        form(1, F.btrim(F.regexp_replace(t, "[^0-9]+", "."), F.lit("."))),
        form(1, F.btrim(F.regexp_replace(t, "[^0-9]+", " "))),
        form(1, F.btrim(F.regexp_replace(F.regexp_replace(t, r"^\+[0-9]+[^0-9]+", ""), "[^0-9]+", "-"), F.lit("-"))),
        form(0, F.regexp_replace(digits, r"(?<=[0-9])(?=(?:[0-9]{3})+$)", ".")),
        form(0, F.concat(at(1, 6), F.lit("."), at(7, 9))),
        form(0, F.concat(at(1, 4), F.lit("-"), at(5, 2), F.lit("-"), at(7, 2))),
        form(0, F.concat(at(1, 4), F.lit("-"), at(5, 4), F.lit(" "), at(9, 4))),
        form(0, digits),
    )
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).otherwise(phone)


def _about(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Whether two spans are about the same: they share three fifths of the longer one."""
    both = F.least(end, other_end) - F.greatest(start, other_start)
    return both * 5 >= F.greatest(end - start, other_end - other_start) * 3


def examples(scanned: DataFrame) -> DataFrame:
    """(half, f, y, n): distinct features of candidates with labels and how often they are."""
    cand = scanned.select("half", "base", F.explode("cands").alias("c"))
    meets = F.exists("base", lambda b: (b["start"] < F.col("c.end")) & (F.col("c.start") < b["end"]))
    right = F.exists("base", lambda b: _about(F.col("c.start"), F.col("c.end"), b["start"], b["end"]))
    real = cand.select("half", "c.f", F.when(right, 1).when(~meets, 0).alias("y"))
    spans = scanned.select("half", F.explode("base").alias("b")).select("half", "b", F.explode(_variants(F.col("b"))).alias("v"))
    left = F.concat(F.col("b.left"), F.when(F.col("b.left").rlike(r"\s$|^$"), "").otherwise(" "))
    made = spans.filter("v.text != ''").select(
        "half", F.col("v.label").alias("y"), F.length(left).alias("at"), F.length("v.text").alias("size"), F.concat(left, F.col("v.text"), F.lit(" "), F.ltrim("b.right")).alias("t")
    )
    made = _candidates(made).select("half", "y", "at", "size", F.explode("cands").alias("c"))
    made = made.filter(_about(F.col("c.start"), F.col("c.end"), F.col("at"), F.col("at") + F.col("size"))).select("half", "c.f", "y")
    return real.filter("y IS NOT NULL").unionByName(made).groupBy("half", "f", "y").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Split:
    """f[feature] <= at goes left."""

    feature: int
    at: int
    left: Split | float
    right: Split | float


@dataclass
class Model:
    """Trees whose values add up to a raw score, and by family the least score (0 to 1) of what is chosen; families that
    have none get nothing added."""

    trees: list[Split | float] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)


def _value(tree: Split | float, f: Column) -> Column:
    if isinstance(tree, Split):
        return F.when(F.get(f, F.lit(tree.feature)) <= tree.at, _value(tree.left, f)).otherwise(_value(tree.right, f))
    return F.lit(float(tree))


def score(model: Model, f: Column) -> Column:
    """0 to 1, in hundredths."""
    raw = F.lit(0.0)
    for tree in model.trees:
        raw = raw + _value(tree, f)
    return F.floor(F.lit(100.0) / (1 + F.exp(-raw))) / 100


def _node(path: dict[int, tuple[int, int]], f: Column) -> Column:
    """Number of the node that f reaches: the root is 1, node i has 2i and 2i + 1; path: feature and limit of each split."""

    def below(i: int) -> Column:
        if i not in path:
            return F.lit(i)
        feature, at = path[i]
        return F.when(F.get(f, F.lit(feature)) <= at, below(2 * i)).otherwise(below(2 * i + 1))

    return below(1)


def _grow(rows: DataFrame) -> Split | float:
    """One tree on rows (f, g, h): by gradients and their curvature, level by level."""
    path: dict[int, tuple[int, int]] = {}
    leaf: dict[int, float] = {}
    for depth in range(DEPTH):
        sums = rows.select(_node(path, F.col("f")).alias("node"), F.posexplode("f").alias("feature", "at"), "g", "h")
        sums = sums.filter(F.col("node") >= 1 << depth).groupBy("node", "feature", "at").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        bins: dict[int, dict[int, list]] = {}
        for r in sums.collect():
            bins.setdefault(r["node"], {}).setdefault(r["feature"], []).append((r["at"], r["g"], r["h"]))
        for node, by in bins.items():
            g, h = (sum(b[i] for b in sorted(by[0])) for i in (1, 2))
            leaf[node] = g / (h + LAMBDA)
            best = (0.0, 0, 0)
            for feature, found in sorted(by.items()):
                gl = hl = 0.0
                for at, dg, dh in sorted(found)[:-1]:
                    gl, hl = gl + dg, hl + dh
                    gain = gl**2 / (hl + LAMBDA) + (g - gl) ** 2 / (h - hl + LAMBDA) - g**2 / (h + LAMBDA)
                    gain = float(f"{gain:.9g}")  # sums differ in their last digits by the order of rows
                    if gain > best[0] + 1e-6:
                        best = (gain, feature, at)
                        leaf[2 * node], leaf[2 * node + 1] = gl / (hl + LAMBDA), (g - gl) / (h - hl + LAMBDA)
            if best[0] > 0:
                path[node] = best[1:]

    def tree(i: int) -> Split | float:
        return Split(*path[i], tree(2 * i), tree(2 * i + 1)) if i in path else round(RATE * leaf.get(i, 0.0), 6)

    return tree(1)


def fit(scanned: DataFrame) -> Model:
    """Trees and thresholds from all candidates of a scanned table."""
    rows = materialize(examples(scanned), "pii_examples")
    if rows.count() <= FEW:
        rows = materialize(rows.coalesce(1), "pii_examples")
    of = {(r["half"], r["y"]): r["n"] for r in rows.groupBy("half", "y").agg(F.sum("n").alias("n")).collect()}
    model = Model()
    if not all(of.get((0, y)) for y in (0, 1)):
        return model
    total = of[0, 0] + of[0, 1]
    # Both labels weigh the same together, and all rows FEW at most, which keeps LAMBDA's part alike at every size.
    scale = min(1.0, FEW / total)
    weight = F.col("n") * F.when(F.col("y") == 1, scale * total / (2 * of[0, 1])).otherwise(scale * total / (2 * of[0, 0]))
    learn = rows.filter("half = 0").select("f", "y", weight.alias("w"))
    for _ in range(TREES):
        raw = F.lit(0.0)
        for t in model.trees:
            raw = raw + _value(t, F.col("f"))
        p = learn.select("f", "y", "w", (1 / (1 + F.exp(-raw))).alias("p"))
        model.trees.append(_grow(p.select("f", (F.col("w") * (F.col("y") - F.col("p"))).alias("g"), (F.col("w") * F.col("p") * (1 - F.col("p"))).alias("h"))))
    model.thresholds = calibrate(rows.filter("half = 1"), model)
    return model


def calibrate(rows: DataFrame, model: Model) -> dict[str, float]:
    """By family the least score such that from it and from each higher one on PRECISION of the examples are right."""
    scored = rows.groupBy(F.get("f", F.lit(0)).alias("family"), score(model, F.col("f")).alias("s"))
    found = scored.agg(F.sum(F.when(F.col("y") == 1, F.col("n"))).alias("right"), F.sum("n").alias("n")).collect()
    limits: dict[str, float] = {}
    for i, family in enumerate(FAMILIES):
        right = n = 0
        for r in sorted((r for r in found if r["family"] == i), key=lambda r: -r["s"]):
            right, n = right + (r["right"] or 0), n + r["n"]
            if right < PRECISION * n:
                break
            limits[family] = r["s"]
    return limits


# ---- choice ---------------------------------------------------------------------------------------------------------

_SPAN = "array<struct<start:bigint,end:bigint,kind:string>>"


def choose(scanned: DataFrame, model: Model) -> DataFrame:
    """(k, base, added): base spans and those that the model adds, (start, end, kind), by kind and start."""
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["kind"].alias("kind"), F.lit(2.0).alias("score")))
    rows = scanned.select("k", base.alias("base"), "cands")
    if not model.thresholds:
        return rows.select("k", F.col("base").cast("array<struct<start:bigint,end:bigint,kind:string,score:double>>").alias("b")).select(
            "k", F.transform("b", lambda s: s.dropFields("score")).alias("base"), F.array().cast(_SPAN).alias("added")
        )
    def limit_of(c):
        out = F.lit(2.0)
        for family, at in model.thresholds.items():
            out = F.when(c["family"] == family, at).otherwise(out)
        return out

    scored = F.transform("cands", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["family"].alias("kind"), F.when(c["f"].isNotNull(), score(model, c["f"])).alias("score"), limit_of(c).alias("limit")))
    chosen = F.transform(F.filter(scored, lambda c: c["score"] >= c["limit"]), lambda c: c.dropFields("limit"))
    rows = rows.withColumn("s", F.array_sort(F.concat("base", chosen)))
    rows = rows.withColumn("ends", F.transform("s", lambda x: x["end"]))
    rows = _running(rows, {"reach": "ends"}, _larger, -1)
    heads = F.filter(F.transform("s", lambda x, i: F.when((i == 0) | (x["start"] >= F.get("reach", i - 1)), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("heads", heads)

    def group(i, j):
        upto = F.coalesce(F.get("heads", j + 1), F.size("s"))
        return F.slice("s", i + 1, upto - i)

    rows = rows.withColumn("groups", F.transform("heads", group))
    alone = F.filter("groups", lambda g: F.forall(g, lambda x: x["score"] <= 1))
    best = lambda g: F.array_max(F.transform(g, lambda x: F.struct(x["score"].alias("score"), (x["end"] - x["start"]).alias("size"), x["kind"].alias("kind"))))
    whole = F.transform(alone, lambda g: F.struct(F.get(g, F.lit(0))["start"].alias("start"), F.array_max(F.transform(g, lambda x: x["end"])).alias("end"), best(g)["kind"].alias("kind")))

    def of(family):
        return F.filter("whole", lambda s: s["kind"] == family)

    rows = rows.withColumn("whole", whole)
    return rows.select("k", F.transform("base", lambda s: s.dropFields("score")).alias("base"), F.concat(*map(of, FAMILIES)).alias("added"))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, base, added) of each row of docs, by a model that these learn themselves. Texts are read once."""
    scanned = materialize(scan(docs, key, text), "pii")
    return choose(scanned, fit(scanned))


def redact(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", mark: str = "[...]") -> DataFrame:
    """(key, text): texts with a mark in place of base and chosen spans, one for those that overlap or touch."""
    whole = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    rows = whole.select(F.struct("key", "text").alias("row"), "text")
    rows = choose(scan(rows, "row", "text"), model)
    rows = rows.select("k", F.array_sort(F.concat("base", "added")).alias("s"))
    rows = _running(rows.withColumn("ends", F.transform("s", lambda x: x["end"])), {"reach": "ends"}, _larger, -1)
    before = lambda i: F.when(i > 0, F.get("reach", i - 1)).otherwise(0)
    cut = lambda a, b: F.substring(F.col("k.text"), (a + 1).cast("int"), (b - a).cast("int"))
    gaps = F.filter(F.transform("s", lambda x, i: F.struct(before(i).alias("a"), x["start"].alias("b"), i.alias("i"))), lambda g: (g["i"] == 0) | (g["a"] < g["b"]))
    marked = F.array_join(F.transform(gaps, lambda g: F.concat(cut(g["a"], g["b"]), F.lit(mark))), "")
    rest = cut(F.coalesce(F.try_element_at("reach", F.lit(-1)), F.lit(0)), F.length("k.text").cast("long"))
    return rows.select(F.col("k.key").alias(key), F.concat(marked, rest).alias(text))
