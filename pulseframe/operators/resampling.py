"""Subject-cluster bootstrap and paired sign-flip tests. Rows are summed to subjects before they are
multiplied by the repetitions; draws are hashes, so results depend on the seed alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import stable_seed

Keys = list[str]


def subject_draws(subjects: DataFrame, subject: str, repeats: int, seed: str = "bootstrap") -> DataFrame:
    """rep, subject, copies: n draws with replacement of n subjects for each repetition."""
    numbered = subjects.select(subject).distinct().withColumn("_i", F.row_number().over(Window.orderBy(subject)) - 1)
    n = numbered.agg(F.count(F.lit(1)).alias("_n"))
    reps = subjects.sparkSession.range(repeats).select(F.col("id").cast("int").alias("rep"))
    draws = reps.crossJoin(F.broadcast(n)).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    draws = draws.withColumn("_i", F.pmod(stable_seed(F.lit(seed), F.col("rep"), F.col("k")), F.col("_n")))
    return draws.groupBy("rep", "_i").agg(F.count(F.lit(1)).alias("copies")).join(F.broadcast(numbered), "_i").select("rep", subject, "copies")


def bootstrap_accuracy(df: DataFrame, keys: Keys, subject: str, repeats: int, seed: str = "bootstrap") -> DataFrame:
    """low, high (2.5 and 97.5 percentiles, linear), valid: accuracy over pooled rows of drawn subjects, and the
    mean absolute error likewise where y is a number."""
    per = df.groupBy(*keys, subject).agg(F.sum((F.col("y_true") == F.col("y_pred")).cast("long")).alias("hits"), F.sum(F.abs(F.col("y_true") - F.col("y_pred")).cast("double")).alias("errors"), F.count(F.lit(1)).alias("n"))
    drawn = per.join(subject_draws(df, subject, repeats, seed), subject)
    reps = drawn.groupBy(*keys, "rep").agg((F.sum(F.col("hits") * F.col("copies")) / F.sum(F.col("n") * F.col("copies"))).alias("accuracy"), (F.sum(F.col("errors") * F.col("copies")) / F.sum(F.col("n") * F.col("copies"))).alias("mae"))
    pct = lambda c, q: F.percentile(c, F.lit(q))
    return reps.groupBy(*keys).agg(
        pct("accuracy", 0.025).alias("accuracy_low"), pct("accuracy", 0.975).alias("accuracy_high"), pct("mae", 0.025).alias("mae_low"), pct("mae", 0.975).alias("mae_high"), F.count("accuracy").alias("valid"),
    )


def _percentiles(reps: DataFrame, keys: Keys, metrics: list[str]) -> DataFrame:
    pct = lambda c, q: F.percentile(c, F.lit(q))
    return reps.groupBy(*keys).agg(*[x for m in metrics for x in (pct(m, 0.025).alias(f"{m}_low"), pct(m, 0.975).alias(f"{m}_high"))], *[F.count(m).alias(f"{m}_valid") for m in metrics])


def bootstrap_classes(df: DataFrame, keys: Keys, subject: str, labels: list[int], repeats: int, seed: str = "bootstrap") -> DataFrame:
    """low, high and valid draws of accuracy, balanced accuracy, macro F1, Matthews correlation and primary score. Rows are summed to
    (subject, true, predicted) first; a drawn subject counts as often as it was drawn, and repeated ones stay separate copies in
    the primary score. Values that are undefined in a draw (a class is missing) are left out of its percentiles."""
    from .evaluate import class_metrics, summary_metrics

    cells = df.groupBy(*keys, subject, F.col("y_true").cast("int").alias("y_true"), F.col("y_pred").cast("int").alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))
    draws = subject_draws(df, subject, repeats, seed)
    by = [*keys, "rep"]
    matrix = cells.join(draws, subject).groupBy(*by, "y_true", "y_pred").agg(F.sum(F.col("n") * F.col("copies")).alias("n"))
    values = F.array(*[F.lit(x) for x in labels])
    grid = matrix.select(*by).distinct().withColumn("y_true", F.explode(values)).withColumn("y_pred", F.explode(values))
    full = grid.join(matrix, [*by, "y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    summary = summary_metrics(class_metrics(full, by), by).select(*by, "accuracy", "balanced_accuracy", "f1_macro", "mcc")
    recall = cells.groupBy(*keys, subject, "y_true").agg((F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("r"))
    per = recall.join(draws, subject).groupBy(*by, "y_true").agg((F.sum(F.col("r") * F.col("copies")) / F.sum("copies")).alias("r"))
    primary = per.groupBy(*by).agg(F.avg("r").alias("primary"))
    return _percentiles(summary.join(primary, by), keys, ["accuracy", "balanced_accuracy", "f1_macro", "mcc", "primary"])


#: Numbers of the ranks of true values that go to all tasks, of a task's rows times draws, and draws at a time where the ranks travel with the rows.
RANKS_MOST, BLOCK, DRAWS = 8 << 20, 4 << 20, 16


class _Ranks:
    """Average ranks of rows sorted by value in many draws at once, from the middle rank on. `copies` (subjects x draws) tells how often each draw has a subject."""

    def __init__(self, copies: np.ndarray, before: np.ndarray, total: np.ndarray):
        self.copies, self.before, self.middle = copies, before.astype(float), (total + 1) / 2

    def blocks(self, values: np.ndarray, who: np.ndarray, n: np.ndarray):
        """(rows, weights, ranks) of blocks of whole runs of equal values; weights and ranks are rows x draws."""
        starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        ends = np.append(starts[1:], len(values))
        at, most = 0, max(1, BLOCK // max(1, self.copies.shape[1]))
        while at < len(starts):
            last = max(at + 1, int(np.searchsorted(ends, starts[at] + most, "right")))
            rows = slice(int(starts[at]), int(ends[last - 1]))
            if rows.stop - rows.start > most:  # one long run, in pieces
                run = np.bincount(who[rows], n[rows], minlength=len(self.copies)) @ self.copies
                self.before = self.before + run
                for low in range(rows.start, rows.stop, most):
                    piece = slice(low, min(low + most, rows.stop))
                    weight = self.copies[who[piece]] * n[piece, None].astype(float)
                    yield piece, weight, np.repeat((self.before - (run - 1) / 2 - self.middle)[None], len(weight), axis=0)
                at = last
                continue
            weight = self.copies[who[rows]] * n[rows, None].astype(float)
            run = np.add.reduceat(weight, starts[at:last] - starts[at])
            upto = self.before + run.cumsum(0)
            yield rows, weight, np.repeat(upto - (run - 1) / 2 - self.middle, ends[at:last] - starts[at:last], axis=0)
            self.before = upto[-1]
            at = last


def _counts_before(rows: DataFrame, part: str, copies: np.ndarray) -> tuple[dict, dict]:
    """Weights of all parts before, for each (part, group), and of each group; vectors over the draws. Parts x groups x subjects reach the driver."""
    t = rows.groupBy(part, "_g", "_who").agg(F.sum("_n").alias("_n")).toArrow()
    part, g, who, n = (t[c].to_numpy() for c in (part, "_g", "_who", "_n"))
    before, total = {}, {}
    for k in np.unique(g):
        mine = g == k
        names, at = np.unique(part[mine], return_inverse=True)
        counts = np.zeros((len(names), len(copies)), dtype=np.int64)
        np.add.at(counts, (at, who[mine]), n[mine])
        upto = (counts @ copies).cumsum(0)
        before |= {(int(p), int(k)): b for p, b in zip(names, np.concatenate([np.zeros_like(upto[:1]), upto[:-1]]))}
        total[int(k)] = upto[-1]
    return before, total


def _rank_correlations(df: DataFrame, keys: Keys, subject: str, draws: DataFrame, repeats: int) -> DataFrame:
    """keys, rep, spearman_rho: rank correlation of y_true and y_pred in every draw; pairs with a missing value are left out.

    Rows are the distinct (subject, true, predicted) values, once and not once per draw: sorted by value in ranges, each task ranks its range for all draws at once by running sums,
    from the counts of the ranges before. Few true values go to all tasks with their ranks; otherwise the ranks of `DRAWS` draws at a time travel with the rows.
    """
    from .nested import settled

    spark = df.sparkSession
    drawn = draws.select(subject, "rep", "copies").toArrow()  # subjects x draws
    names = sorted(set(drawn[subject].to_pylist()), key=str)
    place = {s: i for i, s in enumerate(names)}
    copies = np.zeros((len(names), repeats), dtype=np.int64)
    copies[[place[s] for s in drawn[subject].to_pylist()], drawn["rep"].to_numpy()] = drawn["copies"].to_numpy()
    kinds = dict(df.dtypes)
    subjects = spark.createDataFrame(list(enumerate(names)), f"_who int, `{subject}` {kinds[subject]}")
    groups = [tuple(r) for r in df.select(*keys).distinct().collect()] if keys else [()]
    known = spark.createDataFrame([(i, *g) for i, g in enumerate(groups)], ", ".join(["_g int", *(f"`{k}` {kinds[k]}" for k in keys)]))
    cells = df.select(*keys, subject, *[F.col(c).cast("double").alias(c) for c in ("y_true", "y_pred")]).filter("y_true is not null and y_pred is not null")
    cells = cells.groupBy(*keys, subject, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(subjects), subject)
    cells = cells.join(F.broadcast(known), keys) if keys else cells.withColumn("_g", F.lit(0))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of = lambda rows, value, part: settled(rows.repartitionByRange(parts, "_g", value).sortWithinPartitions("_g", value).withColumn(part, F.spark_partition_id()))
    by_pred = of(cells.select("_g", "_who", "y_true", "y_pred", "_n"), "y_pred", "_py")
    some = by_pred.select("_g", "y_true").distinct().count()
    before_y, total = _counts_before(by_pred, "_py", copies)
    few = some * min(DRAWS, repeats) <= RANKS_MOST
    width = max(1, min(repeats, RANKS_MOST // max(some, 1))) if few else min(DRAWS, repeats)
    if few:
        t = by_pred.groupBy("_g", "y_true", "_who").agg(F.sum("_n").alias("_n")).orderBy("_g", "y_true").toArrow()
        true = {int(g): [t[c].to_numpy()[t["_g"].to_numpy() == g] for c in ("y_true", "_who", "_n")] for g in np.unique(t["_g"].to_numpy())}
    else:
        by_true = of(by_pred, "y_true", "_px")
        before_x, _ = _counts_before(by_true, "_px", copies)

    found = []
    for low in range(0, repeats, width):
        cut = slice(low, low + width)
        ranks = {}
        for g, (value, who, n) in true.items() if few else ():
            got = [(value[rows], r) for rows, _, r in _Ranks(copies[:, cut], np.zeros(copies[:, cut].shape[1]), total[g][cut]).blocks(value, who, n)]
            value, r = np.concatenate([v for v, _ in got]), np.concatenate([r for _, r in got])
            once = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
            ranks[g] = value[once], r[once]
        shared = spark.sparkContext.broadcast((copies[:, cut], {k: v[cut] for k, v in total.items()}, {k: v[cut] for k, v in before_y.items()}, ranks, {} if few else {k: v[cut] for k, v in before_x.items()}))

        def rank_true(batches):
            copies, total, _, _, before = shared.value
            now: dict = {}
            for batch in _whole_runs(batches, ["_g", "_px", "y_true"]):
                g, part, value, who, n = (batch.column(c).to_numpy() for c in ("_g", "_px", "y_true", "_who", "_n"))
                for k in np.unique(g).tolist():
                    mine = np.flatnonzero(g == k)
                    state = now.setdefault((int(part[0]), k), _Ranks(copies, before[int(part[0]), k], total[k]))
                    for rows, _, r in state.blocks(value[mine], who[mine], n[mine]):
                        at = pa.array(mine[rows])
                        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("_g", "_py", "y_pred", "_who", "_n")), pa.array([x.tobytes() for x in r], pa.binary())], names=["_g", "_py", "y_pred", "_who", "_n", "_rx"])

        def correlate(batches):
            copies, total, before, ranks, _ = shared.value
            now, sums = {}, {}
            for batch in _whole_runs(batches, ["_g", "_py", "y_pred"]):
                g, part, value, who, n = (batch.column(c).to_numpy() for c in ("_g", "_py", "y_pred", "_who", "_n"))
                for k, p in np.unique(np.stack([g, part]), axis=1).T.tolist():
                    mine = np.flatnonzero((g == k) & (part == p))
                    state = now.setdefault((p, k), _Ranks(copies, before[p, k], total[k]))
                    for rows, weight, y in state.blocks(value[mine], who[mine], n[mine]):
                        if few:
                            x = ranks[k][1][np.searchsorted(ranks[k][0], batch.column("y_true").to_numpy()[mine[rows]])]
                        else:
                            x = np.frombuffer(b"".join(batch.column("_rx").take(pa.array(mine[rows])).to_pylist())).reshape(len(y), -1)
                        sums[k] = sums.get(k, 0) + np.stack([(weight * x * x).sum(0), (weight * y * y).sum(0), (weight * x * y).sum(0)])
            for k, v in sums.items():
                r = v.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([k] * r, pa.int32()), pa.array(np.arange(low, low + r, dtype=np.int32)), *(pa.array(c) for c in v)], names=["_g", "rep", "xx", "zz", "xz"])

        rows = by_pred if few else by_true.mapInArrow(rank_true, "_g int, _py int, y_pred double, _who int, _n long, _rx binary").repartition(parts, "_py").sortWithinPartitions("_py", "_g", "y_pred")
        sums = rows.mapInArrow(correlate, "_g int, rep int, xx double, zz double, xz double").groupBy("_g", "rep").agg(*[F.sum(c).alias(c) for c in ("xx", "zz", "xz")])
        found += [tuple(r) for r in sums.collect()]  # groups x draws
        shared.destroy()
    out = spark.createDataFrame(found, "_g int, rep int, xx double, zz double, xz double")
    rho = F.when((F.col("xx") > 1e-9) & (F.col("zz") > 1e-9), F.col("xz") / F.sqrt("xx") / F.sqrt("zz"))
    return out.join(F.broadcast(known), "_g").select(*keys, "rep", rho.alias("spearman_rho"))


def _whole_runs(batches, by: list[str]):
    """Batches of sorted rows in which no run of rows with equal `by` is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        if held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in by):
            yield pa.concat_batches(held)
            held = []
        if len(edge):
            yield pa.concat_batches([*held, batch.slice(0, int(edge[-1]))])
            held = [batch.slice(int(edge[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.concat_batches(held)


def bootstrap_numbers(df: DataFrame, keys: Keys, subject: str, repeats: int, seed: str = "bootstrap") -> DataFrame:
    """low, high and valid draws of MAE, RMSE, R2, Spearman's rho and primary score (mean of subject MAEs). All but rho come from sums
    per subject; for rho the draws are columns (see `_rank_correlations`)."""
    by = [*keys, "rep"]
    draws = subject_draws(df, subject, repeats, seed)
    y, e = F.col("y_true").cast("double"), F.col("y_true") - F.col("y_pred")
    per = df.groupBy(*keys, subject).agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(e)).alias("a"), F.sum(e * e).alias("q"), F.sum(y).alias("s"), F.sum(y * y).alias("s2"))
    c = F.col("copies")
    t = per.join(draws, subject).groupBy(*by).agg(
        F.sum(F.col("n") * c).alias("n"), F.sum(F.col("a") * c).alias("a"), F.sum(F.col("q") * c).alias("q"), F.sum(F.col("s") * c).alias("s"), F.sum(F.col("s2") * c).alias("s2"),
        (F.sum(F.col("a") / F.col("n") * c) / F.sum(c)).alias("primary"),
    )
    spread = F.col("s2") - F.col("s") * F.col("s") / F.col("n")
    main = t.select(*by, (F.col("a") / F.col("n")).alias("mae"), F.sqrt(F.col("q") / F.col("n")).alias("rmse"), F.when(spread > 1e-9, 1 - F.col("q") / spread).alias("r2"), "primary")
    rho = _rank_correlations(df, keys, subject, draws, repeats)
    return _percentiles(main.join(rho, by), keys, ["mae", "rmse", "r2", "spearman_rho", "primary"])


def comparison_families(candidates: DataFrame) -> DataFrame:
    """comparison, family, candidate_order: groups of two or more candidates that differ in one thing: model,
    representation, input or input mode."""
    kinds = {"models": ["input_id", "mode", "representation"], "representations": ["input_id", "mode", "model"], "inputs": ["mode", "representation", "model"], "modes": ["input_id", "representation", "model"]}
    out = None
    for kind, same in kinds.items():
        one = candidates.withColumns({"comparison": F.lit(kind), "family": F.concat_ws("|", *same)})
        one = one.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("family"))).filter("_n > 1").select("comparison", "family", "candidate_order")
        out = one if out is None else out.unionByName(one)
    return out


def test_count(families: DataFrame, metrics: int) -> DataFrame:
    """tests: pairs of every family times metrics."""
    per = families.groupBy("comparison", "family").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2 * metrics), F.lit(0)).cast("long").alias("tests"))


def contributions(pairs: DataFrame, keys: Keys, subject: str, metric: str) -> DataFrame:
    """keys, subject, d: each subject's share of the metric difference a - b of paired predictions (columns
    y_true_a, y_pred_a, y_pred_b). They add up to the difference."""
    a, b = F.col("y_pred_a"), F.col("y_pred_b")
    y = F.col("y_true_a")
    w = Window.partitionBy(*keys)
    if metric == "mae":
        per = pairs.groupBy(*keys, subject).agg(F.avg(F.abs(y - a) - F.abs(y - b)).alias("m"))
        return per.withColumn("d", F.col("m") / F.count(F.lit(1)).over(w)).drop("m")
    hit = (y == a).cast("double") - (y == b).cast("double")
    if metric == "accuracy":
        per = pairs.groupBy(*keys, subject).agg(F.sum(hit).alias("m"), F.count(F.lit(1)).alias("n"))
        return per.withColumn("d", F.col("m") / F.sum("n").over(w)).drop("m", "n")
    if metric != "primary":
        raise ValueError(f"no such metric: {metric}")
    per = pairs.groupBy(*keys, subject, y.alias("label")).agg(F.avg(hit).alias("m"))
    per = per.withColumn("_s", F.count(F.lit(1)).over(Window.partitionBy(*keys, "label")))
    labels = per.select(*keys, "label").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_l"))
    return per.join(labels, keys).groupBy(*keys, subject).agg(F.sum(F.col("m") / (F.col("_l") * F.col("_s"))).alias("d"))


def sign_flip_test(contrib: DataFrame, keys: Keys, subject: str, repeats: int, seed: str = "flip") -> DataFrame:
    """keys, observed, p = (extreme + 1) / (repeats + 1) over hashed random signs per subject; a sum counts as
    extreme if it reaches the observed one within 8 epsilons."""
    reps = contrib.sparkSession.range(repeats).select(F.col("id").cast("int").alias("rep"))
    sign = 1 - 2 * F.pmod(stable_seed(F.lit(seed), F.col("rep"), F.col(subject)), F.lit(2))
    observed = contrib.groupBy(*keys).agg(F.sum("d").alias("observed"))
    # contributions are one row per pair and subject; the repetitions are a few thousand integers
    sums = contrib.crossJoin(F.broadcast(reps)).groupBy(*keys, "rep").agg(F.sum(F.col("d") * sign).alias("s"))
    tol = 2.220446049250313e-16 * F.greatest(F.lit(1.0), F.abs("observed")) * 8
    out = sums.join(observed, keys).groupBy(*keys, "observed").agg(F.count_if(F.abs("s") + tol >= F.abs("observed")).alias("extreme"))
    return out.select(*keys, "observed", ((F.col("extreme") + 1) / (repeats + 1)).alias("p"))


def paired_tests(predictions: DataFrame, candidates: DataFrame, subject: str, row: Keys, classes: int, repeats: int) -> DataFrame:
    """All comparisons of all families with p, Holm-corrected p and `significant`; incompatible pairs keep a row
    with their status and no p."""
    from .align import candidate_pairs, paired
    from .windows import holm

    families = comparison_families(candidates)
    pairs = candidate_pairs(families, ["comparison", "family"])
    side = lambda name: pairs.join(predictions.withColumnRenamed("candidate_order", name), name)
    key = ["comparison", "family", "order_a", "order_b"]
    joined = paired(side("order_a").select(*key, subject, *row, "y_true", "y_pred"), side("order_b").select(*key, subject, *row, "y_true", "y_pred"), [*key, subject, *row])
    rank = F.max(F.when(F.col("status") == "ok", 0).when(F.col("status") == "incompatible_true_labels", 1).otherwise(2))
    status = joined.groupBy(*key).agg(F.element_at(F.array(*[F.lit(x) for x in ("ok", "incompatible_true_labels", "incompatible_sample_sets")]), rank + 1).alias("status"))
    good = joined.join(status.filter("status = 'ok'").select(*key), key)
    out = None
    for metric in ("primary", "accuracy") if classes else ("mae",):
        one = sign_flip_test(contributions(good, key, subject, metric), key, subject, repeats)
        one = status.join(one, key, "left").withColumn("metric", F.lit(metric))
        out = one if out is None else out.unionByName(one)
    out = holm(out, ["comparison", "family", "metric"]).withColumn("significant", F.col("p_holm") < 0.05)
    # Without any comparison the table says so in one row.
    none = predictions.sparkSession.range(1).join(out.select(F.lit(0).cast("long").alias("id")).limit(1), "id", "left_anti")
    none = none.select(*[F.lit("not_applicable").alias(c) if c == "status" else F.lit(None).cast(out.schema[c].dataType).alias(c) for c in out.columns])
    return out.unionByName(none)
