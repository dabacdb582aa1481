"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Source s gets the token budget ``floor(budget * target_s)``. If that is at least once the source's
tokens, all its documents are taken in that many complete epochs; what is left of the budget goes to
a fractional selection: each document draws the exponential key ``-ln(u) / weight``, documents are
ordered by key, and the longest prefix whose tokens fit the rest is taken. ``u`` comes from the MD5
digest of seed and doc_id, so a draw depends on nothing else.

No source is sorted as a whole. Keys are counted in logarithmic buckets (1/2048 of a natural
logarithm wide, some 155,000 for a source however large it is); the running token sum over buckets
gives the one bucket in which the budget ends, and only the documents of that bucket are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm import scan
from paperloom.session import fresh_name, written

SEED = 42
#: Below this many sources the plan is broadcast; above it the join is left to Spark.
BROADCAST_SOURCES = 20000
_BUCKETS = 2048


def token_count(text: Column) -> Column:
    """Tokens of a text: its words between ASCII white space."""
    return F.arrow_udf(scan.count_space_words, "bigint")(text)


def draw_key(doc_id: Column, weight: Column, seed: int = SEED) -> Column:
    """The exponential key; null, which is never drawn, where the weight is null or not above 0."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return F.when(weight > 0, -F.log(u) / weight)


def _bucket(key: Column) -> Column:
    return F.floor(F.log(key) * _BUCKETS)


def _small(df: DataFrame, rows: int = BROADCAST_SOURCES) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _capped(totals: DataFrame, max_epochs: int) -> DataFrame:
    """``totals`` (source, total, share, size) with ``own``; each round fixes the sources that are full."""
    most = F.col("total") * max_epochs
    held, full = totals.withColumn("full", F.lit(False)), 0
    while True:
        left = held.groupBy().agg(F.sum(F.when(~F.col("full"), F.col("share"))).alias("shares"), F.sum(F.when(F.col("full"), most).otherwise(0)).alias("given"))
        own = F.floor((F.col("size") - F.col("given")) * F.col("share") / F.col("shares"))
        held = held.crossJoin(F.broadcast(left)).withColumn("own", F.when(F.col("full"), most).otherwise(F.least(own, most))).withColumn("full", F.col("full") | (own > most))  # one row
        held = written(held.drop("shares", "given"), "mix-full")
        now = held.where("full").count()
        if now == full:
            return held
        held, full = held.drop("own"), now


def source_plan(items: DataFrame, targets: dict[str, float] | None = None, budget: int | None = None, max_epochs: int | None = None) -> DataFrame:
    """(source, epochs, last_bucket, cut): how much of each source is taken.

    ``items`` has (doc_id, source, tokens, key). Without targets a source's weight is the square root
    of its tokens; given targets are scaled to sum to 1 and a source they don't name gets nothing.
    Without a budget it is the tokens of all items. With ``max_epochs`` no source gets more epochs than
    that, and what it can't take goes to the other sources by their shares, until all fit or are full.
    """
    totals = items.groupBy("source").agg(F.sum("tokens").alias("total")).where("total > 0")
    if targets is None:
        totals = totals.withColumn("share", F.sqrt(F.col("total").cast("double")))
    else:
        named = items.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "name string, share double")
        totals = totals.join(named, F.col("source").eqNullSafe(F.col("name"))).drop("name").where("share > 0")
    all_ = totals.groupBy().agg(F.sum("share").alias("shares"), F.sum("total").alias("tokens"))
    size = F.lit(budget).cast("double") if budget is not None else F.col("tokens").cast("double")
    plan = totals.crossJoin(F.broadcast(all_)).withColumn("own", F.floor(size * F.col("share") / F.col("shares")))  # one row
    if max_epochs is not None:
        plan = _capped(totals.crossJoin(F.broadcast(all_.select(size.alias("size")))), max_epochs)
    plan = plan.withColumn("epochs", F.expr("own div total"))
    plan = written(plan.select("source", "epochs", (F.col("own") - F.col("epochs") * F.col("total")).alias("rest")), "mix-plan")
    keyed = items.where("key is not null").withColumn("bucket", _bucket(F.col("key")))
    counted = keyed.groupBy("source", "bucket").agg(F.sum("tokens").alias("tokens"))
    ran = counted.withColumn("before", F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket")) - F.col("tokens"))
    named_plan = plan.withColumnRenamed("source", "name")
    same = F.col("source").eqNullSafe(F.col("name"))
    ends = written(ran.join(_small(named_plan), same).where("before + tokens > rest").groupBy("source").agg(F.min(F.struct("bucket", "before", "rest")).alias("e")).select(F.col("source").alias("name"), "e.*"), "mix-ends")
    last = keyed.join(_small(ends.withColumnRenamed("bucket", "end")), same & (F.col("bucket") == F.col("end")))
    last = last.withColumn("run", F.sum("tokens").over(Window.partitionBy("source").orderBy("key", "doc_id")) + F.col("before"))
    cuts = last.where("run <= rest").groupBy(F.col("source").alias("cut_source")).agg(F.max(F.struct("key", "doc_id")).alias("cut"))
    out = named_plan.join(ends.select(F.col("name").alias("end_source"), F.col("bucket").alias("last_bucket")), F.col("name").eqNullSafe(F.col("end_source")), "left")
    out = out.join(cuts, F.col("name").eqNullSafe(F.col("cut_source")), "left")
    return written(out.select(F.col("name").alias("source"), "epochs", "last_bucket", "cut"), "mix-cuts")


def take(rows: DataFrame, plan: DataFrame, source: str, doc_id: str, key: Column, epoch: str) -> DataFrame:
    """``rows`` once for each epoch in which they are taken, numbered from 1 in the column ``epoch``."""
    own = {x: fresh_name(rows, f"_{x}") for x in ("source", "epochs", "last_bucket", "cut", "key")}
    plan = plan.select(*(F.col(x).alias(own[x]) for x in ("source", "epochs", "last_bucket", "cut")))
    rows = rows.withColumn(own["key"], key).join(_small(plan), F.col(source).eqNullSafe(F.col(own["source"])))
    bucket, end = _bucket(F.col(own["key"])), F.col(own["last_bucket"])
    cut = F.struct(F.col(own["key"]).alias("key"), F.col(doc_id).alias("doc_id")) <= F.col(own["cut"])
    drawn = F.col(own["key"]).isNotNull() & (end.isNull() | (bucket < end) | ((bucket == end) & F.coalesce(cut, F.lit(False))))
    times = F.col(own["epochs"]) + F.when(drawn, F.lit(1)).otherwise(F.lit(0))
    out = rows.withColumn(own["epochs"], times).where(F.col(own["epochs"]) > 0).withColumn(epoch, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(own["epochs"]))))
    return out.drop(*own.values())


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight): good documents weigh 1, bad ones a quarter, unjudged ones a half."""
    quality = F.col("quality")
    return labels.select("doc_id", F.when(quality == 1, 1.0).when(quality == 0, 0.25).otherwise(0.5).alias("weight"))


def _items(docs: DataFrame, weights: DataFrame, seed: int, other: float) -> DataFrame:
    """(doc_id, source, tokens, key): one row for each document, without texts."""
    weights = weights.groupBy(F.col("doc_id").alias("weight_id")).agg(F.min(F.coalesce("weight", F.lit(0.0))).alias("weight"))
    counted = written(docs.select("doc_id", "source", token_count(F.col("text")).alias("tokens")), "mix-tokens")
    items = counted.join(weights, counted["doc_id"] == weights["weight_id"], "left").withColumn("weight", F.when(F.col("weight_id").isNull(), F.lit(other)).otherwise(F.col("weight")))
    return written(items.select("doc_id", "source", "tokens", draw_key(F.col("doc_id"), F.col("weight"), seed).alias("key")), "mix-items")


def sample_plan(docs: DataFrame, weights: DataFrame, targets: dict[str, float] | None = None, budget: int | None = None, max_epochs: int | None = None, seed: int = SEED, other: float = 0.5) -> DataFrame:
    """(doc_id, source, tokens, epoch): the mixture over all of ``docs``, without texts.

    ``weights`` has (doc_id, weight); documents it doesn't name weigh ``other``, of several weights
    the least counts. A weight that is null or not above 0 keeps a document out of the fractional
    selection, not out of complete epochs. A null source is a source of its own; null or empty texts
    have no tokens, very long ones are counted whole. Rows with equal doc_id draw the same key and are taken together; equal keys go
    by doc_id. Other columns, whatever their names, are not looked at. No rows give no rows.
    """
    items = _items(docs, weights, seed, other)
    return take(items, source_plan(items, targets, budget, max_epochs), "source", "doc_id", F.col("key"), "epoch").select("doc_id", "source", "tokens", "epoch")


def mix_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: int | None = None, max_epochs: int | None = None, seed: int = SEED, other: float = 0.5) -> DataFrame:
    """``docs``, all columns, with documents repeated or left out so that sources meet their budgets.

    The selection is that of :func:`sample_plan` with :func:`quality_weights`. It is made without
    texts and brought back to them by doc_id and source, so the texts are shuffled once. Columns may have any names.
    """
    items = _items(docs, quality_weights(labels), seed, other)
    plan = take(items, source_plan(items, targets, budget, max_epochs), "source", "doc_id", F.col("key"), "epoch")
    own = {c: fresh_name(docs, c) for c in ("_id", "_source", "_times")}
    times = plan.groupBy(F.col("doc_id").alias(own["_id"]), F.col("source").alias(own["_source"])).agg(F.max("epoch").alias(own["_times"]))
    same = F.col("doc_id").eqNullSafe(F.col(own["_id"])) & F.col("source").eqNullSafe(F.col(own["_source"]))
    epoch = fresh_name(docs, "_epoch")
    out = docs.join(times.hint("shuffle_hash"), same).withColumn(epoch, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(own["_times"]))))
    return out.select(*docs.columns)
