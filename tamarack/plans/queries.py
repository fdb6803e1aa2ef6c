"""The registered queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..operators import aggregate, clusters, density, frame, neighbors
from ..operators import transforms as X
from ..streaming import streams
from . import graph, pipeline
from .registry import ORACLES, QUERIES, registered, table


@registered(
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
       avg(l_discount)::DECIMAL(20, 6)::DOUBLE AS mean_discount, count(*) AS n, min(l_extendedprice) AS least, max(l_extendedprice) AS most
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL ORDER BY ALL"""
)
def q_pricing_summary(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    lines = lines.withColumn("disc", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return (
        lines.groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("l_quantity").alias("sum_qty"),
            F.round(F.sum("disc"), 2).alias("sum_disc"),
            F.avg("l_discount").cast("decimal(20,6)").cast("double").alias("mean_discount"),
            F.count("*").alias("n"),
            F.min("l_extendedprice").alias("least"),
            F.max("l_extendedprice").alias("most"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


@registered("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 25 AND l_discount <= 0.05")
def q_filter_project(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    mask = E.both(E.compare(df, "l_quantity", ">", 25.0), E.compare(df, "l_discount", "<=", 0.05))
    return frame.filter_rows(df, mask).select("l_orderkey", "l_linenumber", "l_quantity")


@registered(
    """SELECT l_orderkey, l_linenumber, (l_linenumber + 10)::INT AS plus, (l_linenumber - 3)::INT AS minus, (l_linenumber * 2)::INT AS times,
       (l_linenumber // 2)::INT AS halves, (-l_linenumber)::INT AS negative, l_quantity / 4 AS quarter FROM lineitem"""
)
def q_arith_int_div(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    made = {"plus": ("+", 10), "minus": ("-", 3), "times": ("*", 2), "halves": ("/", 2)}
    out = [E.arithmetic(df, "l_linenumber", op, x).alias(n) for n, (op, x) in made.items()]
    return df.select("l_orderkey", "l_linenumber", *out, E.negative(df, "l_linenumber").alias("negative"), E.arithmetic(df, "l_quantity", "/", 4.0).alias("quarter"))


@registered(
    """SELECT o_orderkey, o_totalprice = 1000 AS eq, o_totalprice <> 1000 AS ne, o_totalprice < 50000 AS lt, o_totalprice >= 50000 AS ge,
       o_orderstatus = 'F' OR o_orderpriority > '3' AS either, NOT (o_orderstatus = 'F') AS negated FROM orders"""
)
def q_compare(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    price = lambda op, x: E.compare(df, "o_totalprice", op, x)
    closed = E.compare(df, "o_orderstatus", "==", "F")
    return df.select(
        "o_orderkey", price("==", 1000.0).alias("eq"), price("!=", 1000.0).alias("ne"), price("<", 50000.0).alias("lt"), price(">=", 50000.0).alias("ge"),
        E.either(closed, E.compare(df, "o_orderpriority", ">", "3")).alias("either"), E.negated(closed).alias("negated"),
    )


@registered("SELECT c_custkey, c_name || c_mktsegment AS label FROM customer")
def q_text_concat(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return df.select("c_custkey", E.arithmetic(df, "c_name", "+", E.Name("c_mktsegment")).alias("label"))


def _grouped(function: str, sql: str):
    def query(spark, sf_dir):
        df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", "l_quantity")
        return aggregate.group_aggregate(df, "l_returnflag", function)

    query.__name__ = f"q_groupby_{function}"
    registered(f"SELECT l_returnflag, {sql} FROM lineitem GROUP BY l_returnflag")(query)


_grouped("sum", "sum(l_linenumber)::INT AS l_linenumber, sum(l_quantity) AS l_quantity")
_grouped("count", "count(*)::INT AS l_linenumber, count(*)::DOUBLE AS l_quantity")
_grouped("mean", "(sum(l_linenumber) // count(l_linenumber))::INT AS l_linenumber, avg(l_quantity) AS l_quantity")
_grouped("min", "min(l_linenumber) AS l_linenumber, min(l_quantity) AS l_quantity")
_grouped("max", "max(l_linenumber) AS l_linenumber, max(l_quantity) AS l_quantity")


@registered("SELECT n_regionkey, string_agg(n_name, '' ORDER BY n_nationkey) AS n_name FROM nation GROUP BY n_regionkey")
def q_text_sum(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    return aggregate.group_aggregate(df, "n_regionkey", "sum", order=["n_nationkey"]).select("n_regionkey", "n_name")


@registered("SELECT sum(o_custkey)::BIGINT AS o_custkey, round(sum(o_totalprice), 2) AS o_totalprice FROM orders")
def q_aggregate_all(spark, sf_dir):
    df = aggregate.aggregate(table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice"), "sum")
    return df.select("o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))


def _joined(how: str, sql_how: str):
    def query(spark, sf_dir):
        # keys of all rows of one side are shifted, so that each side has keys of its own and the joins differ
        orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") + 7).alias("o_custkey"), "o_orderkey")
        customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        return frame.join(orders, customers, "o_custkey", "c_custkey", how, missing="sentinel")

    query.__name__ = f"q_join_{how}"
    low = "-9223372036854775808"
    registered(
        f"""SELECT coalesce(o_custkey, {low}) AS o_custkey, coalesce(o_orderkey, {low}) AS o_orderkey, coalesce(c_custkey, {low}) AS c_custkey,
        coalesce(c_nationkey, -2147483648) AS c_nationkey FROM (SELECT o_custkey + 7 AS o_custkey, o_orderkey FROM orders) {sql_how} JOIN
        customer ON o_custkey = c_custkey"""
    )(query)


for _how, _sql in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL")):
    _joined(_how, _sql)


@registered("SELECT r_regionkey, r_name FROM region, range(3)")
def q_multiply(spark, sf_dir):
    return frame.multiply(table(spark, sf_dir, "region"), 3, "row", "r_regionkey").select("r_regionkey", "r_name")


@registered("SELECT n_nationkey, n_name FROM nation, range(4)")
def q_multiply_block(spark, sf_dir):
    return frame.multiply(table(spark, sf_dir, "nation"), 4, "block", "n_nationkey").select("n_nationkey", "n_name")


@registered("SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 7")
def q_resize(spark, sf_dir):
    return frame.resize(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), 7, "s_suppkey")


@registered("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 0, '' FROM range(30 - (SELECT count(*) FROM nation)::INT)")
def q_resize_beyond(spark, sf_dir):
    return frame.resize(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), 30, "n_nationkey")


@registered("SELECT n_nationkey AS key, n_name AS name FROM nation")
def q_rename(spark, sf_dir):
    return frame.rename(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["key", "name"])


@registered("SELECT key, name, coalesce(segment, '') AS segment FROM (SELECT s_suppkey AS key, s_name AS name, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer)")
def q_concat(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return frame.concat([s, c])


@registered("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 100")
def q_sort_head(spark, sf_dir):
    return frame.sort(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), ["p_retailprice", "p_partkey"], ascending=False).limit(100)


@registered("SELECT * FROM (SELECT p_partkey, p_size FROM part ORDER BY p_partkey DESC LIMIT 7) ORDER BY p_partkey")
def q_tail(spark, sf_dir):
    return frame.tail(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", 7)


@registered("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS index FROM orders")
def q_index(spark, sf_dir):
    return frame.with_index(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@registered("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer) JOIN (SELECT unnest([3, 1, 3]) AS i) USING (i)")
def q_take(spark, sf_dir):
    return frame.take(table(spark, sf_dir, "customer").select("c_custkey"), [3, 1, 3], "c_custkey")


@registered("SELECT vec_id, " + ", ".join(f'embedding[{i + 1}] AS "v.{i}"' for i in range(64)) + " FROM embeddings")
def q_flatten(spark, sf_dir):
    return frame.flatten(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v")))


@registered("SELECT p_partkey, CASE WHEN p_size > 25 THEN 0 ELSE p_size END::INT AS p_size FROM part")
def q_set_where(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return frame.set_where(df, "p_size", E.compare(df, "p_size", ">", 25), 0)


@registered("SELECT l_orderkey, l_linenumber, round((l_quantity - m) / s, 6) AS q FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem)")
def q_scaler_meanvar(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return X.Scaler("q:l_quantity").fit(df).transform(df).select("l_orderkey", "l_linenumber", F.round("q", 6).alias("q"))


@registered("SELECT l_orderkey, l_linenumber, round((l_tax - m) / (x - m), 6) AS q FROM lineitem, (SELECT min(l_tax) AS m, max(l_tax) AS x FROM lineitem)")
def q_scaler_minmax(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_tax")
    return X.Scaler("q:l_tax", "minMax").fit(df).transform(df).select("l_orderkey", "l_linenumber", F.round("q", 6).alias("q"))


@registered(
    """SELECT l_orderkey, l_linenumber, a AS p0, b AS p1, a * a AS p2, a * b AS p3, b * b AS p4, a * a * a AS p5, a * a * b AS p6, a * b * b AS p7, b * b * b AS p8
       FROM (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_linenumber::DOUBLE AS b FROM lineitem)"""
)
def q_poly(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_quantity", F.col("l_linenumber").cast("double")).alias("v"))
    out = X.Polynomial("v", 3).transform(df)
    return out.select("l_orderkey", "l_linenumber", *(F.col("v")[i].alias(f"p{i}") for i in range(9)))


@registered(
    """SELECT event_id, round((a * t + b - value)::FLOAT::DOUBLE, 2) AS trend FROM (SELECT event_id, value, floor(epoch(ts)) / 86400 AS t FROM events),
       (SELECT regr_slope(value, t) AS a, regr_intercept(value, t) AS b FROM (SELECT value, floor(epoch(ts)) / 86400 AS t FROM events))"""
)
def q_detrend(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "value", (F.col("ts").cast("timestamp").cast("long").cast("double") / 86400).alias("time"))
    out = X.Detrend("trend:value").fit(df).transform(df)
    return out.select("event_id", F.round(F.col("trend").cast("double"), 2).alias("trend"))


@registered("SELECT 'value' AS \"column\", min(value) AS min, max(value) AS max, round(sum(value), 2) AS sum, round(sum(value * value), 2) AS sum2, count(*) AS nb FROM events")
def q_describe(spark, sf_dir):
    found = aggregate.moments(table(spark, sf_dir, "events"), ["value"])
    return found.withColumns({"sum": F.round("sum", 2), "sum2": F.round("sum2", 2)})


@registered("SELECT event_type AS value, count(*) AS n FROM events GROUP BY event_type")
def q_hist(spark, sf_dir):
    return aggregate.histogram(table(spark, sf_dir, "events"), "event_type")


def _drawn(seed: int, key: str) -> str:
    """SQL of ``frame.draw``."""
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {key})), 1, 12))::UBIGINT::DOUBLE / 281474976710656::DOUBLE"


@registered(f"""SELECT o_orderkey, CASE WHEN {_drawn(42, "o_orderkey")} >= {2 / 3!r}::DOUBLE THEN 1 ELSE 0 END::INT AS "splitTrain0Test1" FROM orders""")
def q_split(spark, sf_dir):
    return X.SplitTrainTest("o_orderkey").transform(table(spark, sf_dir, "orders").select("o_orderkey"))


@registered(
    f"""WITH RECURSIVE p(k, p, total) AS (SELECT 0, exp(-1.5::DOUBLE), exp(-1.5::DOUBLE) UNION ALL SELECT k + 1, p * 1.5 / (k + 1), total + p * 1.5 / (k + 1) FROM p WHERE k < 25),
        t AS (SELECT o_orderkey, (SELECT count(*) FROM p WHERE u >= total) AS n FROM (SELECT o_orderkey, {_drawn(42, "o_orderkey")} AS u FROM orders))
        SELECT o_orderkey FROM (SELECT o_orderkey, unnest(range(n)) FROM t)"""
)
def q_resample(spark, sf_dir):
    return X.Resample("o_orderkey", 1.5).transform(table(spark, sf_dir, "orders").select("o_orderkey"))


@registered(f"SELECT o_orderkey, o_totalprice, o_totalprice + {_drawn(42, 'o_orderkey')} AS noisy FROM orders")
def q_add_random(spark, sf_dir):
    return X.AddRandom("noisy:o_totalprice", "o_orderkey").transform(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"))


@registered(f"SELECT o_orderkey FROM orders ORDER BY {_drawn(0, 'o_orderkey')}, o_orderkey LIMIT 20")
def q_sample(spark, sf_dir):
    return frame.sample(table(spark, sf_dir, "orders").select("o_orderkey"), 20, "o_orderkey", distinct=True)


@registered(f"SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part) JOIN (SELECT floor({_drawn(0, 'range')} * (SELECT count(*) FROM part)) AS i FROM range(50)) USING (i)")
def q_sample_repeats(spark, sf_dir):
    return frame.sample(table(spark, sf_dir, "part").select("p_partkey"), 50, "p_partkey")


@registered("SELECT vec_id, e.label, c AS b_class, c = e.label AS b FROM embeddings e, (SELECT DISTINCT label AS c FROM embeddings)")
def q_m2b_default(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return X.MultiToBinary("label", "b", m=100).fit(df).transform(df)


def _near(metric: str, sql: str):
    def query(spark, sf_dir):
        df = table(spark, sf_dir, "embeddings")
        return neighbors.knn(df, df, 5, metric).select("id", "rank", "neighbor", F.abs(F.round("distance", 5)).alias("distance"))

    query.__name__ = f"q_knn_{metric.lower()}"
    registered(
        f"""SELECT id, rank::INT AS rank, neighbor, abs(round(d, 5)) AS distance FROM (SELECT id, neighbor, d, row_number() OVER (PARTITION BY id ORDER BY d, neighbor) AS rank FROM
        (SELECT a.vec_id AS id, b.vec_id AS neighbor, {sql} AS d FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a, (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b)) WHERE rank <= 5"""
    )(query)


_near("L2", "list_distance(a.e, b.e)")
_near("L1", "list_sum(list_transform(list_zip(a.e, b.e), lambda p: abs(p[1] - p[2])))")
_near("cosine", "1 - list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e)))")


@registered(
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
       near AS (SELECT a.vec_id AS id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS place FROM e a, e b)
       SELECT id, label, count(*) / 5 AS score FROM near WHERE place <= 5 GROUP BY id, label"""
)
def q_knn_classify(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    return neighbors.knn_classify(df, df, "label")


def _points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))


@registered(
    """WITH RECURSIVE p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
       pairs AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM p a, p b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.05::DOUBLE * 0.05::DOUBLE),
       core AS MATERIALIZED (SELECT a FROM pairs GROUP BY a HAVING count(*) >= 5),
       links AS MATERIALIZED (SELECT a, b FROM pairs WHERE a IN (FROM core) AND b IN (FROM core)),
       reach(a, b) AS (SELECT a, a FROM core UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
       root AS MATERIALIZED (SELECT a, min(b) AS root FROM reach GROUP BY a),
       member AS (FROM root UNION ALL SELECT q.a, min(r.root) FROM pairs q JOIN root r ON q.b = r.a WHERE q.a NOT IN (SELECT a FROM root) GROUP BY q.a),
       named AS (SELECT root, row_number() OVER (ORDER BY root) AS cluster FROM (SELECT root FROM member GROUP BY root HAVING count(*) >= 5))
       SELECT id, coalesce(cluster, -1)::INT AS cluster, CASE WHEN cluster IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS score FROM p LEFT JOIN (SELECT a AS id, cluster FROM member JOIN named USING (root)) USING (id)"""
)
def q_dbscan(spark, sf_dir):
    return clusters.dbscan(_points(spark, sf_dir), 0.05, 5, "vec_id", ["x", "y"])


@registered()
def q_optics(spark, sf_dir):
    return neighbors.optics(_points(spark, sf_dir), 0.2, 5, "vec_id", ["x", "y"])


@registered("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM orders WHERE o_totalprice < 50000")
def q_tag_append(spark, sf_dir):
    orders, tags = table(spark, sf_dir, "orders"), pipeline.Tags()
    tags.tag("cheap", orders.where("o_totalprice < 50000").select("o_orderkey"))
    return tags.append(orders.where("o_orderstatus = 'F'").select("o_orderkey"), "cheap")


@registered("SELECT o_orderkey FROM orders WHERE o_totalprice < 50000")
def q_selecttag(spark, sf_dir):
    orders, tags = table(spark, sf_dir, "orders"), pipeline.Tags()
    tags.tag("cheap", orders.where("o_totalprice < 50000").select("o_orderkey"))
    return tags.select("cheap", store="closed", current=orders.where("o_orderstatus = 'F'").select("o_orderkey"))


@registered("SELECT p_partkey, p_retailprice, p_retailprice * 1.5 AS price FROM part")
def q_udf_map(spark, sf_dir):
    return frame.apply(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "price", lambda x: x * 1.5, "p_retailprice", "double")


@registered("SELECT p_partkey, p_size, p_retailprice, (p_size * 2 + p_retailprice)::DOUBLE AS made FROM part WHERE p_size % 3 = 1")
def q_lambda_steps(spark, sf_dir):
    steps = [X.LambdaFilter("p_size", lambda x: x % 3 == 1), X.Lambda("made:p_size,p_retailprice", lambda a, b: a * 2 + b)]
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return pipeline.Pipeline(steps).train(parts).transform(parts)


@registered("SELECT n_nationkey, upper(n_name) AS name, i::INT AS copy FROM nation, (SELECT unnest(range(2)) AS i) WHERE n_regionkey > 0")
def q_value_mapper(spark, sf_dir):
    def made(row):
        return [{"n_nationkey": row["n_nationkey"], "name": row["n_name"].upper(), "copy": i} for i in range(2) if row["n_regionkey"] > 0]

    return X.ValueMapper(made, "n_nationkey int, name string, copy int").transform(table(spark, sf_dir, "nation"))


@registered("SELECT max(l_quantity) - min(l_quantity) AS value FROM lineitem")
def q_array_aggregate(spark, sf_dir):
    ends = aggregate.combine(table(spark, sf_dir, "lineitem"), "l_quantity", lambda x: [x.min(), x.max()], lambda e: [min(v[0] for v in e), max(v[1] for v in e)], "array<double>")
    return ends.select((F.col("value")[1] - F.col("value")[0]).alias("value"))


@registered("SELECT n_nationkey, n_name, (i * 3)::INT AS triple FROM (SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation)")
def q_add_column(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return frame.add_column(nations, "triple", [3 * i for i in range(nations.count())], "int", "n_nationkey")


@registered("SELECT p_partkey, trunc(p_retailprice)::BIGINT AS p_retailprice FROM part")
def q_as_type(spark, sf_dir):
    return frame.as_type(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "I8")


@registered("SELECT * FROM (SELECT p_partkey, p_size, 'left' AS side FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, 0, 'right' FROM part WHERE p_size > 25)")
def q_differences(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return frame.differences(df, frame.set_where(df, "p_size", E.compare(df, "p_size", ">", 25), 0))


@registered("SELECT n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY n_regionkey, n_nationkey")
def q_join_ordered(spark, sf_dir):
    nations, regions = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return frame.join(nations, regions, 2, 0, order=["n_nationkey"])


@registered("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 4 <> 0")
def q_na_filter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("price"))
    return pipeline.Pipeline(["NAFilter{col=price}"]).train(orders).transform(orders)


@registered(
    """SELECT event_id, round((value - m) / (x - m), 6) AS q FROM events, (SELECT min(value) AS m, max(value) AS x FROM events)"""
)
def q_stream_transform(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value")
    scaler = X.Scaler("q:value", "minMax").fit(events)
    stream = streams.read_stream(spark, f"{sf_dir}/event[s].parquet", events.schema)
    return streams.run_to_end(streams.apply_fitted(stream, [scaler]), "scaled").select("event_id", F.round("q", 6).alias("q"))


@registered(
    """SELECT start, key, round(sum(value), 4) AS total, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS start, event_type AS key, value FROM events)
       WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL"""
)
def q_stream_windows(spark, sf_dir):
    # windows that the watermark has closed by the end
    events = table(spark, sf_dir, "events")
    stream = streams.read_stream(spark, f"{sf_dir}/event[s].parquet", events.schema)
    return streams.run_to_end(streams.windowed_sums(stream, "ts", "event_type", "value"), "windows").withColumn("total", F.round("total", 4))


@registered("SELECT date_trunc('hour', ts) AS start, event_type AS key, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY ALL")
def q_windowed_sums(spark, sf_dir):
    found = streams.windowed_sums(table(spark, sf_dir, "events"), "ts", "event_type", "value")
    return found.withColumn("total", F.round("total", 4))


@registered("SELECT c_mktsegment, coalesce(c_nationkey, -1) AS c_nationkey, sum(c_acctbal)::DECIMAL(20, 2)::DOUBLE AS total FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def q_rollup(spark, sf_dir):
    return table(spark, sf_dir, "customer").rollup("c_mktsegment", "c_nationkey").agg(F.sum("c_acctbal").cast("decimal(20,2)").cast("double").alias("total")).withColumn("c_nationkey", F.coalesce("c_nationkey", F.lit(-1)))


@registered("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def q_semi_join(spark, sf_dir):
    dear = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(dear, "c_custkey", "left_semi")


@registered("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def q_anti_join(spark, sf_dir):
    buyers = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(buyers, "c_custkey", "left_anti")


@registered("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def q_intersect(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@registered("SELECT c_custkey AS key FROM customer EXCEPT SELECT s_suppkey FROM supplier")
def q_except(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).subtract(table(spark, sf_dir, "supplier").select("s_suppkey"))


@registered("SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))::INT AS place FROM orders) WHERE place <= 3")
def q_window_rank(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    places = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return orders.withColumn("place", F.row_number().over(places)).where("place <= 3").select("o_custkey", "o_orderkey", "place")


@registered("SELECT c_mktsegment, c_nationkey, grouping_id(c_mktsegment, c_nationkey)::INT AS level, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def q_cube(spark, sf_dir):
    cubed = table(spark, sf_dir, "customer").cube("c_mktsegment", "c_nationkey")
    return cubed.agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"))


@registered("SELECT row_number() OVER (ORDER BY p_size, place) - 1 AS rank, place FROM (SELECT p_size, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part)")
def q_argsort(spark, sf_dir):
    return frame.argsort(table(spark, sf_dir, "part"), "p_size", "p_partkey")


@registered("SELECT label, count(*)::DOUBLE AS weight FROM embeddings GROUP BY label")
def q_label_histogram(spark, sf_dir):
    return aggregate.label_histogram(table(spark, sf_dir, "embeddings"), "label")


@registered("SELECT n_regionkey, string_agg(upper(n_name), '' ORDER BY n_nationkey) AS value FROM nation GROUP BY n_regionkey")
def q_fold(spark, sf_dir):
    return aggregate.fold(table(spark, sf_dir, "nation"), ["n_regionkey"], "n_name", ["n_nationkey"], F.lit(""), lambda a, x: F.concat(a, F.upper(x)))


@registered("SELECT c_nationkey, count(*) AS n, max(c_acctbal) - min(c_acctbal) AS spread FROM customer GROUP BY c_nationkey")
def q_each_group(spark, sf_dir):
    def spread(rows: pd.DataFrame) -> pd.DataFrame:
        balance = rows["c_acctbal"]
        return pd.DataFrame({"c_nationkey": [rows["c_nationkey"].iloc[0]], "n": [len(rows)], "spread": [balance.max() - balance.min()]})

    customers = table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal")
    return aggregate.for_each_group(customers, "c_nationkey", spread, "c_nationkey int, n long, spread double")


@registered("SELECT p_partkey, p_size FROM part WHERE p_size % 7 = 3")
def q_lambda_filter(spark, sf_dir):
    return frame.filter_by(table(spark, sf_dir, "part").select("p_partkey", "p_size"), lambda x: x % 7 == 3, "p_size")


@registered("SELECT n_nationkey, CASE WHEN i IN (0, 2, 4) THEN 'none' ELSE n_name END AS n_name FROM (SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation)")
def q_set_at(spark, sf_dir):
    return frame.set_at(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_name", [0, 2, 4], "none", "n_nationkey")


@registered("SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'nan'::FLOAT ELSE (n_regionkey - 1)::FLOAT END AS label FROM nation")
def q_code_to_label(spark, sf_dir):
    return X.CodeToLabel("label:n_regionkey").transform(table(spark, sf_dir, "nation")).select("n_nationkey", "label")


@registered("SELECT p_partkey, (10 - s / 2) + (20 - s / 2) + (s - 2.5) + (s - 7.5) AS shaken FROM (SELECT p_partkey, p_size::DOUBLE AS s FROM part)")
def q_shake_input(spark, sf_dir):
    # variants (10, size), (20, size) and (size, 5), (size, 15) of (size, size), each scored by x0 - x1 / 2
    parts = table(spark, sf_dir, "part").select("p_partkey", F.array_repeat(F.col("p_size").cast("double"), 2).alias("v"))
    shaken = X.ShakeInput("v", (0, 1), ((10.0, 20.0), (5.0, 15.0)), "shaken", lambda v: v[0] - v[1] / 2, "add").transform(parts)
    return shaken.select("p_partkey", "shaken")


@registered(
    """WITH s AS (SELECT l_orderkey, l_linenumber, (l_quantity - m) / (x - m) AS q FROM lineitem, (SELECT min(l_quantity) AS m, max(l_quantity) AS x FROM lineitem))
       SELECT l_orderkey, l_linenumber, round(q, 6) AS q FROM s UNION ALL SELECT l_orderkey, l_linenumber, round(q, 6) FROM s"""
)
def q_graph(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    out = graph.Graph().run(lines, ["Chain{xf1=Scaler{col=q:l_quantity scale=minMax} xf2=Tag{t=scaled}}", "Append{t=scaled}"])
    return out.select("l_orderkey", "l_linenumber", F.round("q", 6).alias("q"))


@registered(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
       near AS (SELECT a.vec_id AS id, b.vec_id AS other, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS place FROM e a, e b)
       SELECT id AS vec_id, place::INT AS place, other AS neighbor, abs(round(d, 5)) AS distance FROM near WHERE place <= 3"""
)
def q_knn_append(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = density.NearestNeighbors(3, "L2", "embedding", "vec_id").fit(df).transform(df)
    pairs = out.select("vec_id", F.posexplode(F.arrays_zip(F.col("idNeighbors").alias("n"), F.col("Distances").alias("d"))).alias("place", "p"))
    return pairs.select("vec_id", (F.col("place") + 1).alias("place"), F.col("p.n").alias("neighbor"), F.abs(F.round("p.d", 5)).alias("distance"))


@registered()
def q_optics_clusters(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 2).alias("v"))
    return density.Optics("v", "0.05,0.1", 5, "vec_id").transform(points).drop("v")


@registered()
def q_iova(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("double").alias("Label"), F.col("embedding").alias("Features"))
    return pipeline.Pipeline([], "iOVA{p=ft{maxIter=3}}").train(df).predict(df).select("vec_id", "Label", "prediction")


@registered()
def q_oova(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("double").alias("Label"), F.col("embedding").alias("Features"))
    return pipeline.Pipeline([], "OOVA{p=lr{maxIter=5}}").train(df).predict(df).select("vec_id", "Label", "prediction")
