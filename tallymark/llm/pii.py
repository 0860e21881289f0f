"""Personal data by candidate gradient boosting, in DataFrame operations alone.

1. Generators: one strict pattern per kind, and looser ones of high recall, propose spans that may
   overlap. A pattern's matches and the pieces between them give texts, places and context.
2. Base spans are strict matches that pass their check (octets, Luhn, digit counts); they stay.
3. Every candidate has features of format and context, none of which is a check. Nobody has marked
   the loose spans of a corpus, so boosted depth-two trees learn from its strict ones: those that
   pass, rewritten into each loose form in their own context, are the positives; those that fail,
   rewritten alike, and the loose spans found as they are, are the others. The few true ones among
   the latter are what is to be found: they look like the positives and unlike their fellows. All
   candidates count, as rows of equal features with their numbers; each level of a tree is one
   aggregation to gradient sums per feature and value.
4. On the fifth of the candidates that no tree has seen, the least score whose precision is high
   enough becomes the threshold of the kind. Loose candidates above it whose plain form (marks undone)
   passes the kind's check are added to the base spans.

Texts are read once. What is shuffled are candidates, a few dozen characters each, by a number of
their row, so that equal ids do not meet and no id is hot. Building runs jobs: candidates and their
counted features are written, and each tree takes two.

Defined cases: a null or empty text has no spans; texts of any length are searched whole. Repeated
rows and rows without an id each keep a row. Gradients are added as whole numbers, so their order
does not matter. Extra columns are not read, whatever their names. Patterns repeat groups possessively, so that runs of any
length need no stack. With an empty table, or candidates of one class, nothing is added.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymark.llm.common import store

KINDS = ("email", "ip", "card", "phone", "secret")

#: Strict patterns. A match starts where the one before has ended or where its first run starts;
#: it cannot start within a run, as the run's start would have matched or failed alike.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: What may stand for the at sign of an address, and for a dot.
AT = r"\s?[(\[{]\s?(?:at|@)\s?[)\]}]\s?"
DOT = r"\s?[(\[{]\s?(?:dot|\.)\s?[)\]}]\s?|\sdot\s"

#: Loose patterns by kind, each with a cheaper pattern that a text must hold first.
LOOSE = {
    "email": (
        rf"[A-Za-z0-9._%+-]{{1,64}}{AT}[A-Za-z0-9-]{{1,63}}(?:(?:{DOT}|\.)[A-Za-z0-9-]{{1,63}}){{1,8}}",
        r"[(\[{]\s?(?:at|@)\s?[)\]}]",
    ),
    "ip": (
        rf"(?<![0-9.])[0-9]{{1,4}}(?:(?:{DOT}|\s?\.\s?)[0-9]{{1,4}}){{3,5}}(?![0-9])",
        rf"[0-9](?:{DOT}|\s?\.\s?)[0-9]",
    ),
    "card": (r"(?<![0-9])[0-9](?:[\x20._/-]{0,3}[0-9]){12,19}(?![0-9])", r"[0-9][\x20._/-]{0,3}[0-9]"),
    "phone": (r"(?<![0-9])[+(]?[0-9](?:[\x20()./-]{0,2}[0-9]){8,15}(?![0-9])", r"[0-9][\x20()./-]{0,2}[0-9]"),
    "secret": (
        r"(?<=[:=]\s{0,2}[\"']{0,1})[A-Za-z0-9_/+~-]{16,}+",
        r"(?i)(?:token|secret|passw|key|auth)",
    ),
}

#: Words before a candidate that speak for a kind.
CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|kontakt|correo|courriel)",
    "ip": r"(?i)(?:\bip\b|server|host|address|node|login)",
    "card": r"(?i)(?:card|visa|credit|konto|tarjeta|carte|pay)",
    "phone": r"(?i)(?:phone|call|tel|mobil|fax|sms)",
    "secret": r"(?i)(?:token|secret|passw|key|auth)",
}

TREES = 8
RATE = 0.5
PRECISION = 0.9
#: Parts of one in which gradients are added.
GRAIN = 1_000_000


def proposals(text: Column, generator: str, kind: str, pattern: str, guard: str | None) -> Column:
    """Matches in order: struct(generator, kind, gap before, match, text around)."""
    pattern_ = F.lit(pattern)
    found = F.regexp_extract_all(text, pattern_, F.lit(0))
    pieces = F.split(text, pattern_, -1)
    if guard:
        holds = text.rlike(guard)
        found = F.when(holds, found).otherwise(F.array().cast("array<string>"))
        pieces = F.when(holds, pieces).otherwise(F.array().cast("array<string>"))

    # Zipped, so that the arrays are made once for a text and not again for each match.
    zipped = F.arrays_zip(found, F.slice(pieces, 1, 1 << 30), F.slice(pieces, 2, 1 << 30))

    def hit(parts: Column, at: Column) -> Column:
        match, before, after = parts["0"], parts["1"], F.coalesce(parts["2"], F.lit(""))
        return F.struct(
            F.lit(generator).alias("generator"),
            F.lit(kind).alias("kind"),
            at.alias("place"),
            F.length(before).cast("long").alias("gap"),
            match.alias("match"),
            F.right(before, F.lit(24)).alias("before"),
            F.left(after, F.lit(2)).alias("after"),
        )

    return F.filter(F.transform(zipped, hit), lambda h: h["match"].isNotNull())


def candidates(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows (row, id); candidates (row, kind, start, end, match, before, after, strict))."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lists = [proposals(text, f"strict-{k}", k, p, None) for k, p in STRICT.items()]
    lists += [proposals(text, f"loose-{k}", k, p, g) for k, (p, g) in LOOSE.items()]
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.concat(*lists).alias("hits")
    )
    rows = store(rows, "pii-hits")
    hits = rows.select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    length = F.length("match")
    along = W.partitionBy("row", "generator").orderBy("place")
    end = F.sum(F.col("gap") + length).over(along)
    placed = hits.withColumn("end", end).withColumn("start", F.col("end") - length)
    placed = placed.withColumn("strict", F.col("generator").startswith("strict"))
    once = placed.groupBy("row", "kind", "start", "end").agg(
        F.max("strict").alias("strict"),
        F.first("match").alias("match"),
        F.max("before").alias("before"),
        F.max("after").alias("after"),
    )
    return rows.select("row", "id"), once


def passes(kind: Column, match: Column) -> Column:
    """The check of a strict match."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    octet = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", match.rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$"))
        .when(kind == "card", F.length(digits).between(14, 19) & luhn(digits))
        .when(kind == "phone", F.length(digits).between(10, 15))
        .otherwise(False)
    )


def luhn(digits: Column) -> Column:
    """Whether the check sum of up to 19 digits is a multiple of ten."""
    turned = F.reverse(F.left(digits, F.lit(19)))
    value = lambda i: F.coalesce(F.substr(turned, i, F.lit(1)).try_cast("int"), F.lit(0))
    each = F.transform(
        F.sequence(F.lit(1), F.lit(19)),
        lambda i: F.when(i % 2 == 1, value(i)).otherwise(
            value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def plain(kind: Column, match: Column) -> Column:
    """A loose match with its marks undone, as the strict form would be."""
    dots = F.regexp_replace(match, DOT, ".")
    digits = F.regexp_replace(match, "[^0-9]", "")
    return (
        F.when(kind == "email", F.regexp_replace(F.regexp_replace(match, AT, "@"), DOT, "."))
        .when(kind == "ip", F.regexp_replace(dots, r"\s", ""))
        .when(kind == "card", digits)
        .when(kind == "phone", F.concat(F.lit("+"), digits))
        .otherwise(match)
    )


def sound(kind: Column, match: Column) -> Column:
    """Whether the plain form of a loose match passes the kind's check; secrets have none."""
    undone = plain(kind, match)
    address = undone.rlike(r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$") & ~undone.rlike(r"\.\.|@\.")
    return F.when(kind == "email", address).when(kind == "secret", True).otherwise(passes(kind, undone))


def loose_forms(kind: Column, match: Column) -> Column:
    """ARRAY of the loose forms that a strict match may be rewritten into."""
    local, domain = F.regexp_extract(match, "^([^@]*)@", 1), F.regexp_extract(match, "@(.*)$", 1)
    digits = F.regexp_replace(match, "[^0-9]", "")

    def dotted(text: Column, mark: str) -> Column:
        return F.replace(text, F.lit("."), F.lit(mark))

    def grouped(text: Column, size: int, mark: str) -> Column:
        return F.regexp_replace(text, rf"([0-9]{{{size}}})(?=[0-9])", f"$1{mark}")

    bare = F.regexp_replace(match, r"^\+", "")
    return (
        F.when(kind == "email", F.array(
            F.concat(local, F.lit(" [at] "), dotted(domain, " dot ")),
            F.concat(local, F.lit(" (at) "), dotted(domain, " (dot) ")),
            F.concat(local, F.lit("[at]"), domain),
            F.concat(local, F.lit(" (@) "), dotted(domain, "[.]")),
        ))
        .when(kind == "ip", F.array(*(dotted(match, mark) for mark in ("[.]", "(.)", " . ", " dot "))))
        .when(kind == "card", F.array(*(grouped(digits, 4, mark) for mark in (".", "/", "_", " - "))))
        .when(kind == "phone", F.array(
            bare, F.concat(F.lit("00"), digits), grouped(digits, 3, "-"), grouped(digits, 4, " "),
            F.concat(F.lit("("), F.left(digits, F.lit(3)), F.lit(") "), grouped(F.substr(digits, F.lit(4)), 4, "-")),
        ))
        .otherwise(F.array().cast("array<string>"))
    )


def features(kind: Column, match: Column, before: Column, after: Column) -> dict[str, Column]:
    """Small whole numbers that describe format and context."""
    digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    letters = F.length(F.regexp_replace(match, "[^A-Za-z]", ""))
    marks = F.length(match) - digits - letters
    context = reduce(
        lambda rest, k: F.when(kind == k, before.rlike(CONTEXT[k]).cast("int")).otherwise(rest),
        KINDS,
        F.lit(0),
    )
    kinds = reduce(lambda rest, i: F.when(kind == KINDS[i], i).otherwise(rest), range(5), F.lit(5))
    last = F.right(before, F.lit(1))
    first = F.left(after, F.lit(1))
    return {
        "kind": kinds,
        "digits": F.least(digits, F.lit(24)),
        "letters": F.least(F.floor(letters / 4), F.lit(12)).cast("int"),
        "marks": F.least(marks, F.lit(10)),
        "plus": match.startswith("+").cast("int"),
        "dots": F.least(F.length(F.regexp_replace(match, "[^.]", "")), F.lit(5)),
        "blanks": F.least(F.length(F.regexp_replace(match, r"[^\s]", "")), F.lit(6)),
        "doubled": match.rlike(r"[^0-9A-Za-z]{2}").cast("int"),
        "long_run": F.least(F.length(F.regexp_extract(match, r"[0-9]{4,}", 0)), F.lit(20)),
        "mixed": match.rlike(r"[0-9][A-Za-z]+[0-9]").cast("int"),
        "groups": F.least(F.size(F.split(match, r"[^0-9A-Za-z]+")), F.lit(10)),
        "even": match.rlike(r"^[^0-9]?[0-9]{3,4}+(?:[^0-9]++[0-9]{3,4}+)++(?:[^0-9]++[0-9]{1,2}+)?$").cast("int"),
        "spelled": match.rlike(r"(?i)[^a-z](?:at|dot)[^a-z]").cast("int"),
        "boxed": match.rlike(r"[(\[{][.@]").cast("int"),
        "context": context,
        "after_word": last.rlike("[A-Za-z0-9]").cast("int"),
        "before_word": first.rlike("[A-Za-z0-9]").cast("int"),
    }


@dataclass(frozen=True)
class Tree:
    """Two levels: a split of all rows, and one of each side; ``None`` splits nothing."""

    root: tuple[str, int]
    sides: tuple[tuple[str, int] | None, tuple[str, int] | None]
    leaves: tuple[float, float, float, float]

    def score(self) -> Column:
        out = []
        for side in (0, 1):
            split, low, high = self.sides[side], *self.leaves[2 * side : 2 * side + 2]
            out.append(F.when(F.col(split[0]) <= split[1], low).otherwise(high) if split else F.lit(low))
        return F.when(F.col(self.root[0]) <= self.root[1], out[0]).otherwise(out[1])


def _best_split(sums: list[tuple[str, int, float, float]]) -> tuple[float, tuple[str, int]] | None:
    """The (gain, (feature, value)) that splits best, from (feature, value, gradient, curvature)."""
    best = None
    by_name: dict[str, list[tuple[int, float, float]]] = {}
    for name, value, g, h in sums:
        by_name.setdefault(name, []).append((value, g, h))
    for name, values in sorted(by_name.items()):
        values.sort()
        all_g, all_h = sum(g for _, g, _ in values), sum(h for _, _, h in values)
        g = h = 0.0
        for value, dg, dh in values[:-1]:
            g, h = g + dg, h + dh
            gain = g * g / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
            if gain > 1e-9 and (best is None or gain > best[0]):
                best = (gain, (name, value))
    return best


def fit_trees(sample: DataFrame, names: list[str], trees: int, rate: float) -> list[Tree]:
    """Gradient boosting for the logistic loss; ``sample``: features, ``label``, ``n`` rows alike."""
    whole = lambda column: F.round(column * GRAIN).cast("decimal(38,0)")
    out: list[Tree] = []

    def sums(score: Column, side: Column) -> dict[int, list[tuple[str, int, float, float]]]:
        chance = 1 / (1 + F.exp(-score))
        told = sample.select(
            side.alias("side"),
            whole(F.col("n") * (F.col("label") - chance)).alias("g"),
            whole(F.col("n") * chance * (1 - chance)).alias("h"),
            F.explode(
                F.array(*(F.struct(F.lit(x).alias("name"), F.col(x).cast("int").alias("value")) for x in names))
            ).alias("f"),
        )
        found: dict[int, list] = {0: [], 1: []}
        for r in told.groupBy("side", "f.name", "f.value").agg(F.sum("g"), F.sum("h")).collect():
            found[r[0]].append((r[1], r[2], float(r[3]) / GRAIN, float(r[4]) / GRAIN))
        return found

    for _ in range(trees):
        score = reduce(lambda a, t: a + t.score(), out, F.lit(0.0))
        root = _best_split(sums(score, F.lit(0))[0])
        if root is None:
            break
        name, value = root[1]
        halves = sums(score, F.when(F.col(name) <= value, 0).otherwise(1))
        sides, leaves = [], []
        for side in (0, 1):
            split = _best_split(halves[side])
            sides.append(split[1] if split else None)
            one = [s for s in halves[side] if s[0] == (split[1][0] if split else names[0])]
            low = [s for s in one if not split or s[1] <= split[1][1]]
            high = [s for s in one if not split or s[1] > split[1][1]]
            for part in (low, high):
                g, h = sum(s[2] for s in part), sum(s[3] for s in part)
                leaves.append(rate * g / (h + 1))
        out.append(Tree(root[1], tuple(sides), tuple(leaves)))
    return out


def thresholds(sample: DataFrame, score: Column, precision: float) -> dict[str, float]:
    """The least score of each kind from which on the precision of unseen rows is high enough."""
    rows = (
        sample.select("kind", F.round(score, 3).alias("score"), "label", "n")
        .groupBy("kind", "score")
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("good"))
        .collect()
    )
    out = {}
    for number, name in enumerate(KINDS):
        good = every = 0
        for r in sorted((r for r in rows if r.kind == number), key=lambda r: -r.score):
            good, every = good + r.good, every + r.n
            if good >= precision * every:
                out[name] = float(r.score)
    return out


def find_personal_data(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    trees: int = TREES,
    rate: float = RATE,
    precision: float = PRECISION,
) -> DataFrame:
    """(id, spans array<struct<start, order, kind, end, base, score>>), a row per document, in order.

    The trees learn from all loose candidates and all strict ones, each of these in all its loose
    forms; a fifth of both sets the thresholds instead.
    """
    rows, found = candidates(docs, id_col, text_col)
    base = F.col("strict") & passes(F.col("name"), F.col("match"))
    found = store(found.withColumnRenamed("kind", "name").withColumn("base", base), "pii-candidates")
    parts = features(F.col("name"), F.col("match"), F.col("before"), F.col("after"))
    hashed = found.withColumn("hash", F.xxhash64("row", "name", "start"))
    hexes = F.col("match").rlike(r"[0-9]") & F.col("match").rlike(r"[A-Za-z]") & (F.length("match") >= 20)
    natural = hashed.where("NOT strict").withColumn("label", ((F.col("name") == "secret") & hexes).cast("int"))
    forms = loose_forms(F.col("name"), F.col("match"))
    rewritten = hashed.where("strict").withColumn("label", F.col("base").cast("int")).withColumn(
        "match", F.explode(forms)
    )
    sample = natural.unionByName(rewritten).withColumn("unseen", F.pmod("hash", F.lit(5)) == 0)
    sample = sample.select("unseen", "label", *(column.alias(name) for name, column in parts.items()))
    sample = sample.groupBy("unseen", "label", *parts).agg(F.count("*").alias("n"))
    sample = store(sample, "pii-features")
    names = list(parts)
    model = fit_trees(sample.where("NOT unseen"), names, trees, rate)
    raw = reduce(lambda a, t: a + t.score(), model, F.lit(0.0))
    chance = 1 / (1 + F.exp(-raw))
    least = thresholds(sample.where("unseen"), chance, precision) if model else {}
    bound = reduce(
        lambda rest, k: F.when(F.col("name") == k, least[k]).otherwise(rest), least, F.lit(2.0)
    )
    loose = sound(F.col("name"), F.col("match")) & ~F.col("strict")
    scored = found.select(
        "row", "start", "end", "name", "base", loose.alias("loose"),
        *(column.alias(name) for name, column in parts.items()),
    ).withColumn("score", F.round(chance, 3))
    kept = scored.where(F.col("base") | (F.col("loose") & (F.col("score") >= bound)))
    order = reduce(
        lambda rest, i: F.when(F.col("name") == KINDS[i], i).otherwise(rest), range(5), F.lit(5)
    )
    span = F.struct(
        "start", order.alias("order"), F.col("name").alias("kind"), "end", "base", "score"
    )
    lists = kept.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    empty = F.array().cast(lists.schema["spans"].dataType)
    return rows.join(lists, "row", "left").select(
        F.col("id").alias(id_col), F.coalesce("spans", empty).alias("spans")
    )


def told(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def personal_data_counts(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    counts = [count(kind).alias(f"n_{kind}") for kind in STRICT]
    return found.select(
        id_col, *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans")
    )
