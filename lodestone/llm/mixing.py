"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that a document belongs to). A flow
network routes words from each pattern to its sources' quotas: a pattern offers its size once per
repetition level, and a level's cost grows convexly with the repetition, so a second copy is used only
where first copies cannot fill the quotas. Each pattern's flow is then turned into documents in seeded order.

Scale: the driver sees one row per pattern (at most ``max_patterns``, else ValueError), never documents. The
order inside a pattern is that of a path: a hash of the document's id, then its size, then its place in the input. A cut
is found by a histogram of 4096 path prefixes, and the prefix in which it falls is refined by a histogram of its own until
it holds at most CUT_ROWS documents of a pattern; only those are ever ordered within a task, also where one id is that of
very many rows.

Defined results: null text or size counts as 0 words; a null source is a source of its own, ordered last;
documents in no source take nothing; rows with equal ids are ordered by size, equal ones by place; an empty table gives no
rows; other columns pass through untouched, also those named like the operator's own.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from lodestone.llm.common import count_words, maybe_broadcast, numbered, release, stored

MAX_PATTERNS = 100_000
DIGITS = 3  # hexadecimal digits of a path that one histogram takes: 4096 bins for each pattern
PATH = 32 + 16 + 32  # digits of a path: of the hashed id, the size and the place
CUT_ROWS = 10_000


# --- quotas -------------------------------------------------------------------------------------------------


def source_targets(sizes: list[tuple[str | None, int]], weights=(5, 2, 1), share=1.5, most=2.0) -> dict[str | None, float]:
    """Targets by water-filling: weights repeat over the sources by code point (null last), the total is share times
    all sizes, and what exceeds most times a source's size goes to the others by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    demand = [(name, most * size, weights[i % len(weights)]) for i, (name, size) in enumerate(order)]
    left, weight = share * sum(size for _, size in order), sum(w for *_, w in demand)
    targets: dict[str | None, float] = {}
    for name, cap, w in sorted(demand, key=lambda d: d[1] / d[2]):
        targets[name] = min(cap, left * w / weight)
        left, weight = left - targets[name], weight - w
    return targets


# --- flow ---------------------------------------------------------------------------------------------------


class _Network:
    """Maximum flow by blocking flows; edges may be added between calls."""

    def __init__(self) -> None:
        self.edges: list[list[int]] = []  # [to, capacity]; the reverse edge is the neighbour at index ^ 1
        self.out: list[list[int]] = []

    def node(self) -> int:
        self.out.append([])
        return len(self.out) - 1

    def edge(self, a: int, b: int, capacity: int) -> int:
        self.out[a].append(len(self.edges))
        self.out[b].append(len(self.edges) + 1)
        self.edges += [[b, capacity], [a, 0]]
        return len(self.edges) - 2

    def fill(self, source: int, sink: int) -> None:
        while True:
            level = {source: 0}
            queue = deque([source])
            while queue:
                a = queue.popleft()
                for e in self.out[a]:
                    b, capacity = self.edges[e]
                    if capacity > 0 and b not in level:
                        level[b] = level[a] + 1
                        queue.append(b)
            if sink not in level:
                return
            at = [0] * len(self.out)
            path: list[int] = []
            a = source
            while True:
                if a == sink:
                    pushed = min(self.edges[e][1] for e in path)
                    for e in path:
                        self.edges[e][1] -= pushed
                        self.edges[e ^ 1][1] += pushed
                    path, a = [], source
                    continue
                while at[a] < len(self.out[a]):
                    b, capacity = self.edges[self.out[a][at[a]]]
                    if capacity > 0 and level.get(b) == level[a] + 1:
                        break
                    at[a] += 1
                if at[a] < len(self.out[a]):
                    path.append(self.out[a][at[a]])
                    a = self.edges[path[-1]][0]
                elif path:
                    a = self.edges[path.pop() ^ 1][0]
                    at[a] += 1
                else:
                    break


def route(patterns: list[tuple[tuple, int]], quotas: dict, repeats: int = 2) -> list[int]:
    """Words that each pattern (members, size) gives. All costs stand on a pattern's repetition levels and rise with the
    level, so shortest augmenting paths open the levels in turn: filling level after level is a minimum-cost flow."""
    net = _Network()
    start, end = net.node(), net.node()
    sources = {}
    for name, quota in quotas.items():
        sources[name] = net.node()
        net.edge(sources[name], end, round(quota))
    nodes = []
    for members, size in patterns:
        nodes.append(net.node())
        for name in members:
            if name in sources:
                net.edge(nodes[-1], sources[name], repeats * size)
    opened: list[list[int]] = [[] for _ in patterns]
    for _level in range(repeats):
        for k, (_, size) in enumerate(patterns):
            opened[k].append(net.edge(start, nodes[k], size))
        net.fill(start, end)
    return [sum(net.edges[e ^ 1][1] for e in own) for own in opened]


# --- selection ----------------------------------------------------------------------------------------------


def _plan_schema(members: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("members", members), T.StructField("whole", T.LongType()), T.StructField("rest", T.LongType())])


def _meet(rows: DataFrame, few: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """rows joined with a table of a row for each pattern (members, ...)."""
    few = few.withColumnRenamed("members", "_of")
    return rows.join(maybe_broadcast(few, n, 256), F.col("members").eqNullSafe(F.col("_of")), how).drop("_of")


def _cut_bins(rows: DataFrame, wanted: DataFrame, n: int, digits: int) -> DataFrame:
    """(members, cut, rest, n_cut): the bin of path prefixes in which each pattern's rest ends, what of the rest is left in
    it, and its number of documents; `wanted`: (members, rest)."""
    bins = rows.groupBy("members", F.substring("path", 1, digits).alias("cut")).agg(F.sum("size").alias("words"), F.count("*").alias("n_cut"))
    running = W.Window.partitionBy("members").orderBy("cut").rowsBetween(W.Window.unboundedPreceding, -1)
    sums = bins.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    met = _meet(sums, wanted, n).where("before <= rest AND rest < before + words")
    return stored(met.select("members", "cut", (F.col("rest") - F.col("before")).alias("rest"), "n_cut"), "mix-cut")


def _inside(rows: DataFrame, cut: DataFrame, n: int, digits: int) -> DataFrame:
    return _meet(rows, cut, n).where(F.substring("path", 1, digits) == F.col("cut"))


def mix(docs: DataFrame, members: Column, size: Column, order: Column, targets=source_targets, repeats: int = 2, seed: int = 7, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """row (docs' columns as a struct), members, size, copies (0 to repeats).

    members: array of the sources of a document, sorted; size: its words; order: a column that tells rows apart (ties
    by size, then place). targets: from [(source, size)] to {source: words}; a document's size counts towards each of its
    sources."""
    spark = docs.sparkSession
    rows, (file, at) = numbered(docs)
    size = F.coalesce(size, F.lit(0)).cast("long")
    digits = lambda c: F.lpad(F.hex(c), 16, "0")
    digest = F.lower(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(order.cast("string"), F.lit("")))))
    path = F.concat(digest, F.lower(F.concat(digits(size), digits(F.col(file)), digits(F.col(at)))))
    rows = rows.select(F.struct(*docs.columns).alias("row"), members.alias("members"), size.alias("size"), path.alias("path"))
    slim = stored(rows.select("members", "path", "size"), "mix-sizes")

    by_pattern = slim.groupBy("members").agg(F.sum("size").alias("words")).limit(max_patterns + 1).collect()
    if len(by_pattern) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    by_pattern.sort(key=lambda r: [(m is None, m or "") for m in r.members])
    by_source: dict = {}
    for r in by_pattern:
        for m in r.members:
            by_source[m] = by_source.get(m, 0) + r.words
    quotas = targets(list(by_source.items()))
    flows = route([(tuple(r.members), r.words) for r in by_pattern], quotas, repeats)
    plan_rows = [(list(r.members), f // r.words if r.words else 0, f % r.words if r.words else 0) for r, f in zip(by_pattern, flows, strict=True)]
    plan = spark.createDataFrame(plan_rows, _plan_schema(rows.schema["members"].dataType))

    n, width, part = len(plan_rows), DIGITS, slim
    cut = _cut_bins(part, plan.select("members", "rest"), n, width)
    while width < PATH and (cut.agg(F.max("n_cut")).first()[0] or 0) > CUT_ROWS:
        old = part
        part = stored(_inside(part, cut, n, width).select("members", "path", "size"), "mix-part")
        width += DIGITS
        finer = _cut_bins(part, cut.select("members", "rest"), n, width)
        release(old, cut)
        cut = finer

    # Only the documents of the bin in which the cut falls are put in order, to find which of them are taken once more.
    along = W.Window.partitionBy("members").orderBy("path").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    split = _inside(part, cut, n, width).withColumn("upto", F.sum("size").over(along))
    over, under = F.col("upto") - F.col("rest"), F.col("rest") - (F.col("upto") - F.col("size"))
    more = stored(split.where((over <= 0) | ((under > 0) & (over < under))).select(F.col("path").alias("more")), "mix-more")
    release(part)
    ends = plan.drop("rest").join(cut.select(F.col("members").alias("_m"), "cut"), F.col("members").eqNullSafe(F.col("_m")), "left").drop("_m")
    marked = _meet(rows, ends, n).join(maybe_broadcast(more, more.count(), 160), F.col("path") == F.col("more"), "left")
    extra = F.when((F.substring("path", 1, width) < F.col("cut")) | F.col("more").isNotNull(), 1).otherwise(0)
    return marked.select("row", "members", "size", (F.col("whole") + extra).alias("copies"))


# --- query --------------------------------------------------------------------------------------------------


def op10_mixing(docs: DataFrame, repeats: int = 2) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document, its own source being its membership."""
    slim = stored(docs.select("doc_id", "source", count_words(F.col("text")).alias("size")), "mix-sizes")
    sizes = [(r.source, r.words) for r in slim.groupBy("source").agg(F.sum("size").alias("words")).limit(MAX_PATTERNS + 1).collect()]
    if len(sizes) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sources")
    targets = source_targets(sizes)
    mixed = mix(slim, F.array("source"), F.col("size"), F.col("doc_id"), lambda _: targets, repeats)
    per_source = docs.sparkSession.createDataFrame([(s, n, round(float(targets[s]), 6)) for s, n in sizes], "s string, source_size long, target double")
    joined = mixed.join(maybe_broadcast(per_source, len(sizes), 128), F.col("row.source").eqNullSafe(F.col("s")))
    return joined.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, repeats: int = 2) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with the columns of docs."""
    mixed = mix(docs, F.array("source"), count_words(F.col("text")), F.col("doc_id"), repeats=repeats)
    return mixed.where("copies > 0").select("row", F.explode(F.expr("sequence(1, cast(copies as int))")).alias("copy")).select("row.*")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sources
), ordered AS (
  SELECT *, 2.0 * source_size AS cap,
         sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST) - 2.0 * source_size AS caps_before,
         sum(w) OVER () - sum(w) OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST) + w AS w_from,
         1.5 * sum(source_size) OVER () AS total
  FROM weighted
), levels AS (
  SELECT *, (total - caps_before) / w_from AS level FROM ordered
), water AS (
  SELECT max(level) AS level FROM levels
), targets AS (
  SELECT source, source_size, round(CAST(least(cap, water.level * w) AS DOUBLE), 6) AS target,
         CAST(round(least(cap, water.level * w)) AS BIGINT) AS quota
  FROM levels, water
), placed AS (
  SELECT s.*, t.source_size, t.target,
         CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS whole,
         CASE WHEN source_size > 0 THEN quota % source_size ELSE 0 END AS rest,
         sum(size) OVER (PARTITION BY s.source ORDER BY md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size
                         ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN upto <= rest OR (rest > upto - size AND upto - rest < rest - (upto - size)) THEN 1 ELSE 0 END) * size
            AS BIGINT) AS taken
FROM placed
"""
