"""URL verdicts: host and path rules first, boosted trees on the others.

The trees see lexical features, each in at most 16 bins between quantiles of
the labelled URLs. Three of them are shares of blocked URLs by hashed suffix,
domain and first path section; a labelled URL has its shares from the other
folds, so that its own label is no part of them. Each tree sees half of the
features, so that the shares do not hide the others. Equal feature rows of the
labelled URLs are counted together; every level of a tree is one aggregation of
gradients over (node, feature, bin), a table of fixed size from which the
driver picks the splits. A finished model is a column expression, so training
and scoring stay in SQL functions.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentdup.operators.settle import settle

BINS = 16
RATE_SLOTS = 4096
FOLDS = 4
RATES = ["suffix_rate", "domain_rate", "section_rate"]
FEATURES = [
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "params", *RATES,
]


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: the host after the first ``://`` up to ``/ ? #``, ASCII
    letters in lower case, the path then up to ``? #``; both empty without
    ``://`` or URL."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"^(?s).*?://", "")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def deciding_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def _rate_slots(host: Column, path: Column) -> list[Column]:
    """Hashed last label of the host, its last two labels, and the first
    section of the path; each has slots of its own."""
    parts = [F.substring_index(host, ".", -1), F.substring_index(host, ".", -2), F.substring_index(path, "/", 2)]
    return [(F.pmod(F.xxhash64(p), F.lit(RATE_SLOTS)) + i * RATE_SLOTS).cast("int") for i, p in enumerate(parts)]


def _entropy(url: Column) -> Column:
    """Bits per character: log2 n minus the mean of log2 of the counts."""
    n = F.length(url)
    letters = F.array_distinct(F.regexp_extract_all(url, F.lit("(?s)."), F.lit(0)))
    counts = F.transform(letters, lambda c: (n - F.length(F.replace(url, c, F.lit("")))).cast("double"))
    spread = F.aggregate(counts, F.lit(0.0), lambda s, k: s + k * F.log2(k))
    return F.when(n > 0, F.log2(n.cast("double")) - spread / n).otherwise(F.lit(0.0))


def url_features(url: Column, host: Column, path: Column, rates: list[Column]) -> dict[str, Column]:
    """Lexical features as numbers."""
    n = F.length(url)
    digits = n - F.length(F.translate(url, "0123456789", ""))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    params = F.when(query == "", F.lit(0)).otherwise(F.length(query) - F.length(F.translate(query, "&", "")) + 1)
    values = [
        F.length(url),
        F.length(host),
        F.length(path),
        F.length(path) - F.length(F.translate(path, "/", "")),
        F.length(host) - F.length(F.translate(host, ".", "")),
        F.when(n > 0, digits / n).otherwise(F.lit(0.0)),
        n - F.length(F.translate(url, "-", "")),
        _entropy(url),
        params,
        *rates,
    ]
    return {name: value.cast("double") for name, value in zip(FEATURES, values)}


def binned(value: Column, edges: list[float]) -> Column:
    """How many of the edges lie below the value."""
    number = F.lit(0)
    for edge in edges:
        number = number + (value > F.lit(edge)).cast("int")
    return number


@dataclass
class Leaf:
    value: float

    def column(self) -> Column:
        return F.lit(self.value)


@dataclass
class Split:
    feature: int
    upto: int
    left: Leaf | Split
    right: Leaf | Split
    gain: float = 0.0

    def column(self) -> Column:
        return F.when(F.col(FEATURES[self.feature]) <= self.upto, self.left.column()).otherwise(self.right.column())


@dataclass
class UrlModel:
    """Trees, the bounds of the bins of each feature, and the shares of blocked
    URLs by hashed suffix, domain and section."""

    rates: list[float]
    edges: list[list[float]]
    trees: list[Leaf | Split]
    base: float

    def probability(self) -> Column:
        margin = F.lit(self.base)
        for tree in self.trees:
            margin = margin + tree.column()
        return 1 / (1 + F.exp(-margin))

    def gains(self) -> dict[str, float]:
        """What the splits by each feature have gained in all trees."""
        total = dict.fromkeys(FEATURES, 0.0)

        def add(node: Leaf | Split) -> None:
            if isinstance(node, Split):
                total[FEATURES[node.feature]] += node.gain
                add(node.left)
                add(node.right)

        for tree in self.trees:
            add(tree)
        return total


def _table(rates: list[float]) -> Column:
    """A constant array, as one text."""
    return F.split(F.lit(",".join(f"{rate:.6f}" for rate in rates)), ",").cast("array<double>")


def _measured(urls: DataFrame, table: list[float], fold: Column | None, *keep: str) -> DataFrame:
    """Feature values; ``table`` has a share per slot, or per slot and fold."""
    places = [slot + 1 if fold is None else slot * FOLDS + fold + 1 for slot in _rate_slots(F.col("host"), F.col("path"))]
    shares = _table(table)
    features = url_features(F.col("shown"), F.col("host"), F.col("path"), [F.element_at(shares, place) for place in places])
    return urls.select(*keep, *(column.alias(name) for name, column in features.items()))


def _in_bins(measured: DataFrame, edges: list[list[float]], *keep: str) -> DataFrame:
    return measured.select(*keep, *(binned(F.col(name), at).alias(name) for name, at in zip(FEATURES, edges)))


def _quantiles(measured: DataFrame) -> list[list[float]]:
    """At most ``BINS - 1`` distinct bounds of each feature."""
    shares = F.lit([i / BINS for i in range(1, BINS)])
    row = measured.agg(*(F.percentile_approx(name, shares, F.lit(10_000)).alias(name) for name in FEATURES)).first()
    return [sorted(set(row[name] or [])) for name in FEATURES]


def best_split(sums: dict[tuple[int, int], tuple[float, float]], features: list[int], ridge: float) -> tuple[float, int, int]:
    """Gain, feature and last bin on the left of the best split of a node from
    its sums of gradient and hessian by (feature, bin); feature -1 for none.
    Ties go to the first feature and bin."""
    best = (0.0, -1, -1)
    for feature in features:
        total_g = sum(g for (f, _), (g, _) in sums.items() if f == feature)
        total_h = sum(h for (f, _), (_, h) in sums.items() if f == feature)
        g = h = 0.0
        for upto in range(BINS - 1):
            dg, dh = sums.get((feature, upto), (0.0, 0.0))
            g, h = g + dg, h + dh
            if min(h, total_h - h) <= 1e-6:
                continue
            gain = g * g / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
            if gain > best[0] * (1 + 1e-9) + 1e-9:
                best = (gain, feature, upto)
    return best


def _parted(urls: DataFrame, *keep: str) -> DataFrame:
    host, path = url_parts(F.col("url"))
    return urls.select(*keep, F.coalesce("url", F.lit("")).alias("shown"), host.alias("host"), path.alias("path"))


def train_url_model(
    labelled: DataFrame, n_trees: int = 12, depth: int = 3, rate: float = 0.4, ridge: float = 1.0, seed: int = 1
) -> UrlModel:
    """Fit on ``url, blocked`` (0 or 1). Without rows, or with one class only,
    the model is the smoothed share of blocked rows."""
    blocked = labelled.where(F.col("blocked").isNotNull()).select("url", F.col("blocked").cast("bigint").alias("blocked"))
    # Equal URLs are in one fold, or one would tell the label of the other.
    fold = F.pmod(F.xxhash64(F.col("shown"), F.lit(FOLDS)), F.lit(FOLDS)).cast("int")
    parted = _parted(blocked, "blocked").withColumn("fold", fold)
    by_slot = (
        parted.select("blocked", "fold", F.explode(F.array(*_rate_slots(F.col("host"), F.col("path")))).alias("slot"))
        .groupBy("slot", "fold")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("k"))
    )
    # At most RATE_SLOTS * FOLDS rows for each share.
    seen = {(row.slot, row.fold): (row.n, row.k) for row in by_slot.collect()}
    n, k = (sum(pair[i] for (slot, _), pair in seen.items() if slot < RATE_SLOTS) for i in (0, 1))
    share = (k + 1) / (n + 2)
    smoothed = lambda total, hits: (hits + 2 * share) / (total + 2)
    rates, others = [], []
    for slot in range(len(RATES) * RATE_SLOTS):
        parts = [seen.get((slot, fold), (0, 0)) for fold in range(FOLDS)]
        total, hits = (sum(part[i] for part in parts) for i in (0, 1))
        rates.append(smoothed(total, hits))
        others += [smoothed(total - part[0], hits - part[1]) for part in parts]
    model = UrlModel(rates, [[] for _ in FEATURES], [], math.log(share / (1 - share)))
    if not 0 < k < n:
        return model
    measured = _measured(parted, others, F.col("fold"), "blocked")
    model.edges = _quantiles(measured)
    cells = settle(
        _in_bins(measured, model.edges, "blocked").groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("k")),
        "url-cells",
    ).df
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(c).alias("b")) for i, c in enumerate(FEATURES))))
    draw = random.Random(seed)

    def grow(level: int, sums: dict) -> Leaf | Split:
        """``sums`` of this node by (feature, bin): gradient and hessian."""
        gain, feature, upto = best_split(sums, features, ridge) if level < depth else (0.0, -1, -1)
        if feature < 0:
            total_g = sum(g for (f, _), (g, _) in sums.items() if f == 0)
            total_h = sum(h for (f, _), (_, h) in sums.items() if f == 0)
            return Leaf(rate * -total_g / (total_h + ridge))
        return Split(feature, upto, None, None, gain)

    for _ in range(n_trees):
        features = sorted(draw.sample(range(len(FEATURES)), len(FEATURES) // 2))
        p = model.probability()
        base = cells.select(*FEATURES, "n", (F.col("n") * p - F.col("k")).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))
        root: list = [None]
        open_nodes = [(root, 0)]
        for level in range(depth + 1):
            node = _node_number(root[0]) if root[0] is not None else F.lit(0)
            rows = (
                base.select(node.alias("node"), "g", "h", pairs.alias("p"))
                .groupBy("node", "p.f", "p.b")
                .agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
                .collect()  # at most 2^depth nodes of len(FEATURES) * BINS rows
            )
            by_node: dict[int, dict] = {}
            for row in rows:
                by_node.setdefault(row.node, {})[row.f, row.b] = (row.g, row.h)
            following = []
            for number, (holder, place) in enumerate(open_nodes):
                grown = grow(level, by_node.get(number, {}))
                _put(holder, place, grown)
                if isinstance(grown, Split):
                    following += [(grown, 0), (grown, 1)]
            open_nodes = following
            _number_open(open_nodes)
            if not open_nodes:
                break
        model.trees.append(root[0])
    return model


@dataclass
class _Open:
    """A place where a tree still grows."""

    number: int


def _put(holder, place: int, node) -> None:
    if isinstance(holder, list):
        holder[0] = node
    elif place == 0:
        holder.left = node
    else:
        holder.right = node


def _number_open(open_nodes) -> None:
    for number, (holder, place) in enumerate(open_nodes):
        _put(holder, place, _Open(number))


def _node_number(node) -> Column:
    """The open place a row falls into; -1 under a finished leaf."""
    if isinstance(node, _Open):
        return F.lit(node.number)
    if isinstance(node, Leaf):
        return F.lit(-1)
    return F.when(F.col(FEATURES[node.feature]) <= node.upto, _node_number(node.left)).otherwise(_node_number(node.right))


def judge_urls(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """``page_id, host, path, rule, verdict, p_block`` of every page.

    The longest fitting rule decides; where none fits, the trees block at
    ``threshold``. They are trained on ``labelled`` (``url, blocked``), by
    default on the pages that rules decide.

    A null URL, or one without ``://``, has empty host and path and is judged
    by the trees on what text it has. URLs of any length are read whole. Repeated
    rows are judged alike; an empty table gives no rows; further columns are
    ignored.
    """
    host, path = url_parts(F.col("url"))
    text, verdict = deciding_rule(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path")).select(
        "*", text.alias("rule"), verdict.alias("by_rule")
    )
    if labelled is None:
        labelled = judged.where(F.col("rule").isNotNull()).select("url", (F.col("by_rule") == "block").cast("int").alias("blocked"))
    model = train_url_model(labelled)
    shown = judged.withColumn("shown", F.coalesce("url", F.lit("")))
    by_trees = F.when(F.col("p_block") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    keep = ("page_id", "host", "path", "rule", "by_rule")
    return (
        _in_bins(_measured(shown, model.rates, None, *keep), model.edges, *keep)
        .withColumn("p_block", F.round(model.probability(), 9))
        .select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_trees).alias("verdict"), "p_block")
    )
