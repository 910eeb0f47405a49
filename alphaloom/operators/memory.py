"""What earlier iterations taught: tables of patterns and of how fields fared, merged iteration by iteration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.plans.expr import FIELDS
from alphaloom.plans.stored import few, stored

SUCCESS, HIGH_TURNOVER, HIGH_CORR = 0.2, 0.8, 0.8
_BETWEEN = r"[()\s,/*+\-]+"


def field_usage(factors: DataFrame) -> DataFrame:
    """field, n: in how many formulas a field's name occurs. A row for each of the six fields."""
    counted = factors.agg(*(F.count(F.when(F.col("expression").contains(f), 1)).alias(f) for f in FIELDS))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in FIELDS))).alias("x")).select("x.*")


def field_diversity(usage: DataFrame) -> DataFrame:
    """field, n, share, state: over-used above 25 %, under-used below 8 %, as soon as more than three uses are known."""
    total = usage.agg(F.sum("n").alias("total"))
    share = F.coalesce(F.try_divide("n", "total"), F.lit(0.0))
    state = F.when(F.col("total") <= 3, "unknown").when(share > 0.25, "over").when(share < 0.08, "under").otherwise("even")
    return usage.join(F.broadcast(total)).select("field", "n", F.round(share, 4).alias("share"), state.alias("state"))


def tokens(expression: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(expression, _BETWEEN), ""))


def token_jaccard(x: Column, y: Column) -> Column:
    a, b = tokens(x), tokens(y)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def similar(formulas: DataFrame, patterns: DataFrame, bound: float) -> DataFrame:
    """expression, pattern, jaccard of formulas (expression) and patterns (pattern) whose sets of tokens are alike by more than bound, each distinct pair once.

    Two sets that are that alike share one of the rarest tokens of each, so many as its size leaves; only these are
    joined. Sizes are compared before tokens are, and then the sets are counted exactly. A formula without tokens is
    like none.
    """
    one = formulas.select("expression").distinct().select("expression", tokens(F.col("expression")).alias("tokens"))
    other = patterns.select("pattern").distinct().select("pattern", tokens(F.col("pattern")).alias("tokens"))
    often = one.select("tokens").unionByName(other.select("tokens")).select(F.explode("tokens").alias("token")).groupBy("token").count()
    often = stored(often)

    def listed(sets: DataFrame, key: str, as_: str) -> DataFrame:
        each = sets.select(key, F.explode("tokens").alias("token")).join(few(often), "token")
        own = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("count", "token"))), lambda x: x["token"]).alias(as_))
        # Of k tokens at least ceil(bound * k) are shared, so that one of the first k - that + 1 is.
        first = F.size(as_) - F.ceil(F.size(as_) * bound).cast("int") + 1
        return own.select(key, as_, F.explode(F.slice(as_, F.lit(1), first)).alias("token"))

    both = listed(one, "expression", "x").join(listed(other, "pattern", "y"), "token")
    both = both.where((F.size("x") >= F.size("y") * bound) & (F.size("y") >= F.size("x") * bound)).dropDuplicates(["expression", "pattern"])
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("expression", "pattern", (shared / (F.size("x") + F.size("y") - shared)).alias("jaccard")).where(F.col("jaccard") > bound)


def successes(known: DataFrame | None, results: DataFrame) -> DataFrame:
    """pattern, avg_sharpe, times_seen of formulas with |Sharpe| over 0.2: those of earlier iterations with the new ones."""
    new = results.where(F.abs("sharpe") > SUCCESS).groupBy(F.col("expression").alias("pattern")).agg(F.sum("sharpe").alias("total"), F.count("*").alias("times_seen"))
    if known is not None:
        old = known.select("pattern", (F.col("avg_sharpe") * F.col("times_seen")).alias("total"), "times_seen")
        new = old.unionByName(new).groupBy("pattern").agg(F.sum("total").alias("total"), F.sum("times_seen").alias("times_seen"))
    return new.select("pattern", F.round(F.col("total") / F.col("times_seen"), 4).alias("avg_sharpe"), "times_seen")


def failures(known: DataFrame | None, results: DataFrame) -> DataFrame:
    """pattern, times_failed of formulas that were invalid or weak."""
    new = results.where(F.col("classification").isin("invalid", "weak")).groupBy(F.col("expression").alias("pattern")).agg(F.count("*").alias("times_failed"))
    return new if known is None else known.select("pattern", "times_failed").unionByName(new).groupBy("pattern").agg(F.sum("times_failed").alias("times_failed"))


def logs(results: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """The logs of an iteration: errors, high turnover, stability advice, and highly correlated pairs."""
    return {
        "error_log": results.where("classification = 'invalid'").select("factor", "expression", "error"),
        "high_turnover_structures": results.where(F.col("turnover") > HIGH_TURNOVER).select("factor", "expression", "turnover"),
        "stability_improvements": results.where(F.exists("suggestions", lambda s: s.contains("reduce-turnover") | s.contains("adjust-smoothing"))).select("factor", "expression", "suggestions"),
        "high_correlation_pairs": pairs.where(F.col("corr") > HIGH_CORR),
    }


def summary(successful: DataFrame, failed: DataFrame, n: int = 5) -> tuple[DataFrame, DataFrame]:
    return successful.orderBy(F.desc("avg_sharpe"), "pattern").limit(n), failed.orderBy(F.desc("times_failed"), "pattern").limit(n)


def convergence_warning(best: list[tuple[str, float]], concentration: float) -> list[str]:
    """Signs that a search goes in circles, from (name, Sharpe) of each iteration's best and the concentration of field use."""
    out = []
    if len(best) >= 3 and max(s for _, s in best[-3:]) - min(s for _, s in best[-3:]) < 0.005:
        out.append("the best Sharpe has hardly moved in three iterations")
    base = [name.split("_v")[0].split("_llm_")[0] for name, _ in best[-2:]]
    if len(base) == 2 and base[0] == base[1]:
        out.append("the last two best factors are of one family")
    if concentration > 0.6:
        out.append("formulas lean on few fields")
    return out


def concentration(counts: list[int]) -> float:
    """0 if all fields are used alike, 1 if one alone is."""
    total = sum(counts)
    if not total or len(counts) < 2:
        return 0.0
    even = 1 / len(counts)
    return (max(counts) / total - even) / (1 - even)


def best_so_far(memory: dict[str, DataFrame]) -> list[tuple[str, float]]:
    """(factor, Sharpe) of each iteration's best, in order: a row an iteration."""
    return [(r["factor"], r["sharpe"]) for r in memory["best_history"].orderBy("iteration").collect()]


def told(memory: dict[str, DataFrame], n: int = 5) -> list[str]:
    """What a memory has to say, as Markdown lines: how fields are used, what did well and what failed, the last errors and costly factors, how the best went, and signs of going in circles."""
    fields = field_diversity(memory["field_usage"]).orderBy(F.desc("n"), "field").collect()
    out = []
    if sum(r["n"] for r in fields):
        out += ["- fields: " + ", ".join(f"{r['field']} {r['share']:.0%}" for r in fields)]
        out += [f"- {r['field']} is {r['state']}-used" for r in fields if r["state"] in ("over", "under")]
    good, bad = summary(memory["successes"], memory["failures"], n)
    out += [f"- did well: `{r['pattern']}`, Sharpe {r['avg_sharpe']:.3f}, seen {r['times_seen']} times" for r in good.collect()]
    out += [f"- failed: `{r['pattern']}`, {r['times_failed']} times" for r in bad.collect()]
    last = lambda name: memory[name].orderBy(F.desc("iteration"), "factor").limit(n).collect()
    out += [f"- error: {r['factor']}: {r['error'] or 'metrics missing'}" for r in last("error_log")]
    out += [f"- costly: {r['factor']}, turnover {r['turnover']:.2f}" for r in last("high_turnover_structures")]
    best = best_so_far(memory)
    out += [f"- best of iteration {i}: {f}, Sharpe {s:.3f}" for i, (f, s) in enumerate(best, 1)][-n:]
    return out + [f"- beware: {w}" for w in convergence_warning(best, concentration([r["n"] for r in fields]))]


TABLES = {
    "successes": "pattern string, avg_sharpe double, times_seen long",
    "failures": "pattern string, times_failed long",
    "field_usage": "field string, n long",
    "best_history": "iteration int, factor string, sharpe double",
    "error_log": "iteration int, factor string, expression string, error string",
    "high_turnover_structures": "iteration int, factor string, expression string, turnover double",
    "stability_improvements": "iteration int, factor string, expression string, suggestions array<string>",
    "high_correlation_pairs": "iteration int, a string, b string, corr double",
}


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    """A memory that knows nothing: each of TABLES without rows, but for the fields, which have been used 0 times."""
    return {n: spark.createDataFrame([(f, 0) for f in FIELDS] if n == "field_usage" else [], s) for n, s in TABLES.items()}


def load(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The memory of a folder, of its newest whole version or the one that is named; without one, or with 0, it is empty."""
    if version is not None:
        return {n: spark.read.schema(s).parquet(f"{path}/v{version}/{n}") for n, s in TABLES.items()} if version else empty(spark)
    found = empty(spark)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = [str(x.getPath().getName()) for x in fs.listStatus(at)] if fs.exists(at) else []
    if done := sorted(int(v[1:]) for v in versions if v[:1] == "v" and v[1:].isdigit() and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{v}/_COMPLETE"))):
        found = {n: spark.read.schema(s).parquet(f"{path}/v{done[-1]}/{n}") for n, s in TABLES.items()}
    return found


def save(memory: dict[str, DataFrame], path: str, version: int | None = None) -> int:
    """The memory written to the folder as its next version, or as the one that is named, in place of what a broken run has left of it; its number is returned. What load() gave still reads the last one. A version counts once all of its tables are written."""
    spark = next(iter(memory.values())).sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    version = version or max([0, *(int(n[1:]) for x in fs.listStatus(at) if (n := str(x.getPath().getName()))[:1] == "v" and n[1:].isdigit())]) + 1
    for name in TABLES:
        memory[name].write.mode("overwrite").parquet(f"{path}/v{version}/{name}")
    fs.create(jvm.org.apache.hadoop.fs.Path(f"{path}/v{version}/_COMPLETE"), True).close()
    return version


def learn(memory: dict[str, DataFrame], results: DataFrame, pairs: DataFrame, iteration: int) -> dict[str, DataFrame]:
    """The memory after an iteration. results: factor, expression, error, sharpe, turnover, classification, suggestions; pairs: a, b, corr."""
    usage = memory["field_usage"].unionByName(field_usage(results)).groupBy("field").agg(F.sum("n").alias("n"))
    top = results.where(F.col("sharpe").isNotNull()).agg(F.min_by("factor", F.struct(-F.col("sharpe"), F.col("factor"))).alias("factor"), F.max("sharpe").alias("sharpe")).where("factor is not null")
    out = {
        **memory,
        "successes": successes(memory["successes"], results),
        "failures": failures(memory["failures"], results),
        "field_usage": usage,
        "best_history": memory["best_history"].unionByName(top.select(F.lit(iteration).alias("iteration"), "factor", "sharpe")),
    }
    for name, log in logs(results, pairs).items():
        out[name] = memory[name].unionByName(log.withColumn("iteration", F.lit(iteration)).select(*(c.split()[0] for c in TABLES[name].split(", "))))
    return out


def ingest(memory: dict[str, DataFrame], factors: DataFrame) -> dict[str, DataFrame]:
    """The memory with a library of factors (expression, rationale): those with a rationale are successes of Sharpe 0, seen once more each; fields count for all."""
    reasoned = factors.where(F.coalesce("rationale", F.lit("")) != "").groupBy(F.col("expression").alias("pattern")).agg(F.lit(0.0).alias("total"), F.count("*").alias("times_seen"))
    old = memory["successes"].select("pattern", (F.col("avg_sharpe") * F.col("times_seen")).alias("total"), "times_seen")
    both = old.unionByName(reasoned).groupBy("pattern").agg(F.sum("total").alias("total"), F.sum("times_seen").alias("times_seen"))
    usage = memory["field_usage"].unionByName(field_usage(factors)).groupBy("field").agg(F.sum("n").alias("n"))
    return {**memory, "successes": both.select("pattern", F.round(F.col("total") / F.col("times_seen"), 4).alias("avg_sharpe"), "times_seen"), "field_usage": usage}


def transform_effect(results: DataFrame, transforms: list[str]) -> DataFrame:
    """transformation, success_count, avg_sharpe of the transforms by which successes (|Sharpe| over 0.2) came about.

    results: factor, sharpe, transformation; where the last is null, a transform counts if its name is in the factor's,
    with underscores or hyphens.
    """
    spark = results.sparkSession
    names = spark.createDataFrame([(t, t.replace("-", "_")) for t in transforms], "name string, snake string")  # a dozen
    good = results.where(F.abs("sharpe") > SUCCESS)
    fits = (F.col("transformation") == F.col("name")) | (F.col("transformation").isNull() & F.contains(F.translate(F.lower("factor"), "-", "_"), F.col("snake")))
    both = good.join(F.broadcast(names), fits)
    return both.groupBy(F.col("name").alias("transformation")).agg(F.count("*").alias("success_count"), F.round(F.avg("sharpe"), 4).alias("avg_sharpe"))


def upsert_nodes(nodes: DataFrame, results: DataFrame, iteration: int = 1) -> DataFrame:
    """nodes (id, expression, iteration, classification, sharpe, ic_mean, turnover, annual_return, max_drawdown) with the metrics of results (factor, ..., error) on those of the same name; factors without a node are added, failed ones change nothing.

    A class that is known stays; without one a node with metrics is `backtested`.
    """
    metrics = ("sharpe", "ic_mean", "turnover", "annual_return", "max_drawdown")
    new = results.where("error is null").select(F.col("factor").alias("id"), F.col("expression").alias("_e"), *(F.col(m).alias(f"_{m}") for m in metrics), F.lit(True).alias("_new"))
    both = nodes.join(new, "id", "full")
    fresh = F.coalesce("_new", F.lit(False))
    return both.select(
        "id",
        F.coalesce("expression", "_e", "id").alias("expression"),
        F.coalesce("iteration", F.lit(iteration)).alias("iteration"),
        F.coalesce(F.when(F.col("classification") != "", F.col("classification")), F.when(fresh, "backtested")).alias("classification"),
        *(F.when(fresh, F.col(f"_{m}")).otherwise(F.col(m)).alias(m) for m in metrics),
    )
