"""Queries of tile flow, of the two container formats with placed or streamed tiles, of kernels and of the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.scalars import factor_to_20x
from lamella.operators import kernels as K
from lamella.operators import ledger as L
from lamella.operators import planner as P
from lamella.operators import tiles as T
from lamella.plans import fixtures as X
from lamella.plans.registry import query, table

# tile flow

_QUADS = f"""WITH {X.D3_SQL}, q AS (SELECT slide, cx // 2 AS oc, cy // 2 AS orow, max(pixels) FILTER (WHERE cy % 2 = 0 AND cx % 2 = 0) AS q0, max(pixels) FILTER (WHERE cy % 2 = 0 AND cx % 2 = 1) AS q1,
  max(pixels) FILTER (WHERE cy % 2 = 1 AND cx % 2 = 0) AS q2, max(pixels) FILTER (WHERE cy % 2 = 1 AND cx % 2 = 1) AS q3 FROM d3 GROUP BY ALL)"""


def _quads(spark, sf_dir) -> DataFrame:
    return T.quads(X.gray_tiles(spark, sf_dir), ["slide"], "pixels")


@query("quad_gather", _QUADS + "SELECT slide, oc, orow, (q0 IS NOT NULL)::INT + (q1 IS NOT NULL)::INT + (q2 IS NOT NULL)::INT + (q3 IS NOT NULL)::INT AS present, list_sum(q0)::BIGINT AS s0, list_sum(q1)::BIGINT AS s1, list_sum(q2)::BIGINT AS s2, list_sum(q3)::BIGINT AS s3 FROM q")
def quad_gather(spark, sf_dir):
    total = lambda k: F.aggregate(F.col("quad")[k], F.lit(0).cast("long"), lambda a, x: a + x).alias(f"s{k}")
    present = F.size(F.filter("quad", lambda q: q.isNotNull())).alias("present")
    return _quads(spark, sf_dir).select("slide", "oc", "orow", present, *(total(k) for k in range(4)))


@query("compose_canvas", _QUADS + """, c AS (SELECT slide, oc, orow, unnest(range(256)) AS i, q0, q1, q2, q3 FROM q),
p AS (SELECT slide, oc, orow, i, coalesce((CASE (i // 16 // 8) * 2 + (i % 16) // 8 WHEN 0 THEN q0 WHEN 1 THEN q1 WHEN 2 THEN q2 ELSE q3 END)[(i // 16) % 8 * 8 + (i % 16) % 8 + 1], 0) AS v FROM c)
SELECT slide, oc, orow, md5(string_agg(v::VARCHAR, ',' ORDER BY i)) AS canvas_md5, sum(v)::BIGINT AS total FROM p GROUP BY ALL""")
def compose_canvas(spark, sf_dir):
    rows = _quads(spark, sf_dir).withColumn("canvas", K.quad_canvas(F.col("quad"), 8))
    total = F.aggregate("canvas", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("slide", "oc", "orow", F.md5(F.array_join(F.transform("canvas", lambda v: v.cast("string")), ",").cast("binary")).alias("canvas_md5"), total.alias("total"))


@query("tile_upsert", f"SELECT l_orderkey AS slide, l_partkey % 16 AS tile_num, arg_max(l_suppkey, (l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice)) AS data FROM lineitem GROUP BY ALL")
def tile_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("slide"), (F.col("l_partkey") % 16).alias("tile_num"), F.col("l_suppkey").alias("data"), *X.TIE)
    return T.last_wins(rows.withColumn("l_suppkey", F.col("data")), ["slide", "tile_num"], ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"], "data")


@query("ordered_chunks", "SELECT event_id AS tile, user_id % 10 AS slide, floor((row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) - 1) / 32)::BIGINT AS chunk FROM events")
def ordered_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id AS tile", "user_id % 10 AS slide")
    return T.chunks(rows, ["slide"], ["tile"], 32)


@query("jpeg_tables_dictionary", f"SELECT l_orderkey AS ifd, row_number() OVER w AS ord, l_returnflag = first_value(l_returnflag) OVER w AS shared FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {', '.join(X.TIE)})")
def jpeg_tables_dictionary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ifd"), "l_returnflag", *X.TIE)
    rows = T.shared_first(rows, ["ifd"], X.TIE, "l_returnflag")
    return rows.select("ifd", F.row_number().over(Window.partitionBy("ifd").orderBy(*X.TIE)).cast("long").alias("ord"), "shared")


@query("all_formats_union", "SELECT 'dicom' AS format, o_orderkey AS slide, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders UNION ALL SELECT 'tiff', p_partkey, row_number() OVER (ORDER BY p_partkey) FROM part UNION ALL SELECT 'vsi', s_suppkey, row_number() OVER (ORDER BY s_suppkey) FROM supplier")
def all_formats_union(spark, sf_dir):
    """All formats in one table, numbered from 1 in each."""
    buckets = [("dicom", table(spark, sf_dir, "orders"), "o_orderkey"), ("tiff", table(spark, sf_dir, "part"), "p_partkey"), ("vsi", table(spark, sf_dir, "supplier"), "s_suppkey")]
    out = None
    for name, rows, key in buckets:
        one = rows.select(F.lit(name).alias("format"), F.col(key).alias("slide"))
        out = one if out is None else out.unionByName(one)
    return T.numbered(out, "format", "slide")


# streams of tiles with resolutions

_CHUNKS = "k AS (SELECT event_id AS chunk, user_id % 20 AS stream, [event_id % 7 - 1, (event_id // 7) % 5, CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END, event_id % 3] AS coord FROM events)"
_PLANE = f"{_CHUNKS}, plane AS (SELECT stream, greatest(coord[4], 0) AS res, greatest(coord[1], 0) AS x, greatest(coord[2], 0) AS y, max(chunk) AS chunk FROM k WHERE coord[3] = 0 GROUP BY ALL)"


def _plane(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_id AS chunk", "user_id % 20 AS stream", "array(event_id % 7 - 1, event_id div 7 % 5, CASE WHEN event_id % 11 = 0 THEN 1L ELSE 0L END, event_id % 3) AS coord")
    return T.plane_index(rows, True)


@query("ets_supported", "SELECT p_partkey AS stream FROM part WHERE p_size % 4 = 2 AND p_partkey % 4 IN (1, 3) AND p_size % 10 IN (0, 2, 3, 8, 9)")
def ets_supported(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS stream", "p_size % 4 AS pixel_type", "p_partkey % 4 AS channels", "p_size % 10 AS compression")
    return rows.where((F.col("pixel_type") == 2) & F.col("channels").isin(1, 3) & F.col("compression").isin(0, 2, 3, 8, 9)).select("stream")


@query("vsi_plane_index", f"WITH {_PLANE} SELECT * FROM plane")
def vsi_plane_index(spark, sf_dir):
    return _plane(spark, sf_dir)


@query("vsi_extent", f"WITH {_PLANE} SELECT stream, res, max(x) AS mx, max(y) AS my FROM plane GROUP BY ALL")
def vsi_extent(spark, sf_dir):
    return T.extents(_plane(spark, sf_dir))


@query("vsi_grid_fill", f"WITH {_PLANE}, e AS (SELECT stream, res, max(x) AS mx, max(y) AS my FROM plane GROUP BY ALL), c AS (SELECT stream, res, unnest(range(mx + 1)) AS x, my FROM e), g AS (SELECT stream, res, x, unnest(range(my + 1)) AS y FROM c) SELECT g.stream, g.res, g.x, g.y, p.chunk, p.chunk IS NULL AS background FROM g LEFT JOIN plane p USING (stream, res, x, y)")
def vsi_grid_fill(spark, sf_dir):
    return T.grid_fill(_plane(spark, sf_dir), 512).withColumn("background", F.col("chunk").isNull())


@query("vsi_main_pick", "SELECT slide, arg_min(stream, (coalesce(psx, 1e308), -area, stream)) AS stream FROM (SELECT s_nationkey AS slide, s_suppkey AS stream, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 3 / 4.0::DOUBLE END AS psx, (s_suppkey % 7 + 1) * 512 * 512 AS area FROM supplier) GROUP BY slide")
def vsi_main_pick(spark, sf_dir):
    """The stream with the finest pixels, of equal ones the largest."""
    rows = table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS slide", "s_suppkey AS stream", "CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 3 / 4.0D END AS psx", "(s_suppkey % 7 + 1) * 512 * 512 AS area")
    return rows.groupBy("slide").agg(F.min_by("stream", F.struct(F.coalesce("psx", F.lit(1e308)), -F.col("area"), "stream")).alias("stream"))


_HALVE = """WITH RECURSIVE b AS (SELECT p_partkey AS slide, CASE WHEN p_size % 5 <> 0 THEN 4000 + p_partkey % 1201 END AS mw, CASE WHEN p_size % 5 <> 0 THEN 3000 + p_partkey % 977 END AS mh, 512 * (8 + p_partkey % 4) AS ew, 512 * (7 + p_partkey % 3) AS eh FROM part),
l AS (SELECT slide, 0 AS res, coalesce(mw, ew)::BIGINT AS w, coalesce(mh, eh)::BIGINT AS h, ew, eh FROM b
UNION ALL SELECT slide, res + 1, CASE WHEN w % 2 = 1 AND w // 2 < x THEN w // 2 + 1 ELSE least(w // 2, x) END, CASE WHEN h % 2 = 1 AND h // 2 < y THEN h // 2 + 1 ELSE least(h // 2, y) END, ew, eh
FROM (SELECT *, (ew >> (res + 1)) // 512 * 512 + 256 * ((res + 1) % 2) AS x, (eh >> (res + 1)) // 512 * 512 + 256 AS y FROM l) WHERE res < 5)
"""


@query("vsi_halving_levels", _HALVE + ", z AS (SELECT *, min(CASE WHEN w <= 0 OR h <= 0 THEN res END) OVER (PARTITION BY slide) AS stop FROM l) SELECT slide, res, w, h FROM z WHERE stop IS NULL OR res < stop")
def vsi_halving_levels(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS slide", "CASE WHEN p_size % 5 <> 0 THEN 4000 + p_partkey % 1201 END AS mw", "CASE WHEN p_size % 5 <> 0 THEN 3000 + p_partkey % 977 END AS mh", "512 * (8 + p_partkey % 4) AS ew", "512 * (7 + p_partkey % 3) AS eh")
    extent = F.expr("transform(sequence(0, 5), r -> named_struct('w', CASE WHEN r = 0 THEN ew ELSE shiftright(ew, r) div 512 * 512 + 256 * (r % 2) END, 'h', CASE WHEN r = 0 THEN eh ELSE shiftright(eh, r) div 512 * 512 + 256 END))")
    levels = P.halving_levels(F.col("mw"), F.col("mh"), extent)
    return rows.select("slide", F.posexplode(levels).alias("res", "l")).select("slide", "res", "l.w", "l.h")


@query("vsi_level_parity", "WITH s AS (SELECT s_suppkey AS slide, 1 + s_suppkey % 7 AS n FROM supplier), m AS (SELECT slide, n, unnest([0, 1, 2]) AS start FROM s), r AS (SELECT *, unnest(range(n)) AS res FROM m) SELECT slide, start, res FROM r WHERE (start > 0 AND n <= start) OR (res >= start AND (res - start) % 2 = 0)")
def vsi_level_parity(spark, sf_dir):
    """Every second resolution from the start on; all, if there are not enough."""
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS slide", "1 + s_suppkey % 7 AS n").withColumn("start", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    rows = rows.withColumn("res", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return rows.where("(start > 0 AND n <= start) OR (res >= start AND (res - start) % 2 = 0)").select("slide", "start", "res")


@query("positional_zip", "WITH a AS (SELECT s_nationkey AS slide, s_name AS path, row_number() OVER w AS n, count(*) OVER (PARTITION BY s_nationkey) AS t FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_name)), b AS (SELECT c_nationkey AS slide, c_name AS meta, row_number() OVER w AS n, count(*) OVER (PARTITION BY c_nationkey) AS t FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_name)) SELECT a.slide, a.path, b.meta FROM a LEFT JOIN b USING (slide, n, t)")
def positional_zip(spark, sf_dir):
    left = table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS slide", "s_name AS path")
    right = table(spark, sf_dir, "customer").selectExpr("c_nationkey AS slide", "c_name AS path", "c_name AS meta")
    return T.positional_pairs(left, right, ["slide"], "path").select("slide", "path", "meta")


@query("raw_tile_decode", "SELECT vec_id AS tile, list_sum(r)::BIGINT AS r, list_sum(b)::BIGINT AS b, len(r)::INT AS n FROM (SELECT vec_id, [p[i] FOR i IN range(1, 64, 3)] AS r, [p[i] FOR i IN range(3, 64, 3)] AS b FROM (SELECT vec_id, list_transform(embedding, lambda e: greatest(0, least(255, floor(e::DOUBLE * 128 + 128)::INT))) AS p FROM embeddings))")
def raw_tile_decode(spark, sf_dir):
    """Interleaved samples of a raw tile, in blue-green-red order, as planes."""
    rows = X.gray_tiles(spark, sf_dir)
    plane = lambda k: F.transform(F.sequence(F.lit(k), F.lit(k + 60), F.lit(3)), lambda i: F.col("pixels")[i])
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select((F.col("slide") * 64 + F.col("cy") * 8 + F.col("cx")).alias("tile"), total(plane(0)).alias("r"), total(plane(2)).alias("b"), F.size(plane(0)).alias("n"))


# placed captures

@query("ini_parse", "WITH o AS (SELECT * FROM orders) SELECT o_orderkey AS slide, '' AS section, 'k0' AS key, o_custkey::VARCHAR AS value FROM o UNION ALL SELECT o_orderkey, 'GENERAL', 'SLIDE_ID', o_orderpriority || '=x' FROM o UNION ALL SELECT o_orderkey, 'DATA', 'FILE_COUNT', (o_custkey % 9)::VARCHAR FROM o")
def ini_parse(spark, sf_dir):
    text = F.expr("concat_ws('\\n', concat('k0 = ', o_custkey), '; note = 1', '[GENERAL]', concat(' SLIDE_ID = ', o_orderpriority, '=x'), '', '[DATA]', concat('FILE_COUNT=', o_custkey), concat('FILE_COUNT = ', o_custkey % 9), 'no pair')")
    lines = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slide"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return T.ini_pairs(lines, ["slide"])


@query("prefix_record", "WITH t AS (SELECT l_orderkey AS slide, row_number() OVER w AS i, l_linenumber AS n, CASE WHEN l_quantity % 4 = 0 THEN 'POSITIONS' ELSE 'OTHER' END AS name FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY " + ", ".join(X.TIE) + ")), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY slide ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t) SELECT slide, coalesce(arg_min(before, i) FILTER (WHERE name = 'POSITIONS'), -1)::BIGINT AS record FROM b GROUP BY slide")
def prefix_record(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("slide"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*X.TIE)).alias("i"), F.col("l_linenumber").alias("count"), F.when(F.col("l_quantity") % 4 == 0, "POSITIONS").otherwise("OTHER").alias("name"))
    return T.prefix_before(rows, "POSITIONS")


@query("position_fallback_grid", "SELECT s_suppkey AS slide, i AS cp, round(i % 5 * 502.0)::BIGINT AS px, round(i // 5 * 506.5)::BIGINT AS py FROM supplier, range(20) t(i)")
def position_fallback_grid(spark, sf_dir):
    grid = T.regular_grid(20, 5, 256, 2, 10, 5.5)
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("slide"), F.explode(grid).alias("g")).select("slide", "g.*")


_ENTRIES = "e AS (SELECT user_id % 10 AS slide, event_id, event_id % 130 - 2 AS image_index FROM events), pos AS (SELECT slide, i AS cp, CASE WHEN i % 7 = 3 THEN 0 ELSE round(i % 5 * 502.0)::BIGINT END AS px, CASE WHEN i % 7 = 3 THEN 0 ELSE round(i // 5 * 506.5)::BIGINT END AS py FROM range(10) s(slide), range(25) t(i))"


@query("mirax_placement", f"""WITH {_ENTRIES}, g AS (SELECT *, image_index % 10 AS gx, floor(image_index / 10.0)::BIGINT AS gy FROM e WHERE image_index >= 0), c AS (SELECT *, gx // 2 AS xp, gy // 2 AS yp, gy // 2 * 5 + gx // 2 AS cp FROM g WHERE gy < 10)
SELECT c.slide, event_id AS seq, px + 256 * (gx % 2) AS place_x, py + 256 * (gy % 2) AS place_y FROM c JOIN pos USING (slide, cp) WHERE NOT (px = 0 AND py = 0 AND (xp <> 0 OR yp <> 0))""")
def mirax_placement(spark, sf_dir):
    entries = table(spark, sf_dir, "events").selectExpr("user_id % 10 AS slide", "event_id AS seq", "event_id % 130 - 2 AS image_index")
    dummy = lambda g: F.when(g.cp % 7 == 3, F.struct(g.cp.alias("cp"), F.lit(0).cast("long").alias("px"), F.lit(0).cast("long").alias("py"))).otherwise(g)
    grid = F.transform(T.regular_grid(25, 5, 256, 2, 10, 5.5), dummy)
    positions = spark.range(10).select(F.col("id").alias("slide"), F.explode(grid).alias("g")).select("slide", "g.*")
    out = T.placed(entries.where("image_index >= 0"), positions, 10, 10, 256, 2)
    return out.select("slide", "seq", "place_x", "place_y")


_BOX = f"{X.D4_SQL}, n AS (SELECT slide, seq, x - min(x) OVER w AS x, y - min(y) OVER w AS y, size FROM d4 WINDOW w AS (PARTITION BY slide)), box AS (SELECT *, max(x + size) OVER w AS width, max(y + size) OVER w AS height FROM n WINDOW w AS (PARTITION BY slide))"


@query("bbox_normalize", f"WITH {_BOX} SELECT * FROM box")
def bbox_normalize(spark, sf_dir):
    return T.normalized(X.placements(spark, sf_dir)).select("slide", "seq", "x", "y", "size", "width", "height")


@query("mirax_levels", """WITH b AS (SELECT p_partkey AS slide, 600 + p_partkey * 13 % 9000 AS w, 500 + p_partkey * 7 % 8000 AS h, (p_size - 2) / 40.0::DOUBLE AS mpp FROM part), d AS (SELECT *, CASE WHEN mpp > 0 AND 0.8 > mpp THEN 0.8 / mpp ELSE 1 END::DOUBLE AS d FROM b), l AS (SELECT *, unnest(range(41)) AS k FROM d)
SELECT slide, k::INT AS level, greatest(round(w / (d * 2::DOUBLE ** k)), 1)::BIGINT AS w, greatest(round(h / (d * 2::DOUBLE ** k)), 1)::BIGINT AS h FROM l WHERE k = 0 OR round(greatest(w, h) / (d * 2::DOUBLE ** (k - 1))) >= 512""")
def mirax_levels(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS slide", "600 + p_partkey * 13 % 9000 AS w", "500 + p_partkey * 7 % 8000 AS h", "(p_size - 2) / 40.0D AS mpp")
    base = F.when((F.col("mpp") > 0) & (F.col("mpp") < 0.8), F.lit(0.8) / F.col("mpp")).otherwise(1.0)
    rows = rows.select("slide", "w", "h", F.posexplode(P.doubling_levels(F.col("w"), F.col("h"), base)).alias("level", "d"))
    side = lambda c: F.greatest(F.round(F.col(c) / F.col("d")), F.lit(1)).cast("long").alias(c)
    return rows.select("slide", "level", side("w"), side("h"))


_CELLS = f"""{_BOX}, s AS (SELECT slide, seq, round(x / 2.0)::BIGINT AS x, round(y / 2.0)::BIGINT AS y, greatest(round(size / 2.0), 1)::BIGINT AS size, greatest(round(width / 2.0), 1)::BIGINT AS iw, greatest(round(height / 2.0), 1)::BIGINT AS ih FROM box),
g AS (SELECT *, least(greatest(x, 0) // 512, (iw + 511) // 512 - 1) AS cx0, least(greatest(x + size - 1, 0) // 512, (iw + 511) // 512 - 1) AS cx1, least(greatest(y, 0) // 512, (ih + 511) // 512 - 1) AS cy0, least(greatest(y + size - 1, 0) // 512, (ih + 511) // 512 - 1) AS cy1 FROM s),
cells AS (SELECT slide, cx, unnest(range(cy0, cy1 + 1)) AS cy, seq, x, y, size FROM (SELECT *, unnest(range(cx0, cx1 + 1)) AS cx FROM g))"""


@query("cell_explode", f"WITH {_CELLS} SELECT * FROM cells")
def cell_explode(spark, sf_dir):
    return T.covered_cells(T.normalized(X.placements(spark, sf_dir)), 2.0)


@query("painter_overwrite", f"WITH {_CELLS}, p AS (SELECT slide, cx, cy, seq, unnest(range(greatest(x // 64, cx * 8), least((x + size - 1) // 64, cx * 8 + 7) + 1)) AS px, y, size FROM cells), q AS (SELECT slide, seq, px, unnest(range(greatest(y // 64, cy * 8), least((y + size - 1) // 64, cy * 8 + 7) + 1)) AS py FROM p) SELECT slide, px, py, max(seq) AS value FROM q GROUP BY ALL")
def painter_overwrite(spark, sf_dir):
    """Which placement is on top of each 64-pixel block."""
    cells = T.covered_cells(T.normalized(X.placements(spark, sf_dir)), 2.0)
    blocks = lambda v, c: F.sequence(F.greatest(F.floor(F.col(v) / 64), F.col(c) * 8), F.least(F.floor((F.col(v) + F.col("size") - 1) / 64), F.col(c) * 8 + 7))
    rows = cells.withColumn("px", F.explode(blocks("x", "cx"))).withColumn("py", F.explode(blocks("y", "cy"))).withColumn("value", F.col("seq"))
    return K.painted(rows, ["slide"])


_PAGES = "pages_ AS (SELECT c_nationkey AS slide, c_custkey AS page, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS next, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n, c_acctbal FROM customer)"


@query("linked_page_walk", f"WITH {_PAGES} SELECT slide, page, n - 1 AS hop FROM pages_")
def linked_page_walk(spark, sf_dir):
    """How many pages come before each one, from pages that point to the next."""
    order = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("slide"), F.col("c_custkey").alias("page"), F.lead("c_custkey").over(order).alias("next"))
    return T.page_hops(rows)


# kernels

@query("ycbcr_to_rgb", """WITH v AS (SELECT DISTINCT (l_partkey % 256)::INT AS y, (l_suppkey * 7 % 256)::INT AS cb, (l_orderkey * 3 % 256)::INT AS cr FROM lineitem), f AS (SELECT *, y::FLOAT AS fy, cb::FLOAT - 128::FLOAT AS fb, cr::FLOAT - 128::FLOAT AS fr FROM v)
SELECT y, cb, cr, greatest(0, least(255, trunc(fy + 1.402::FLOAT * fr)::INT)) AS r, greatest(0, least(255, trunc(fy - 0.34414::FLOAT * fb - 0.71414::FLOAT * fr)::INT)) AS g, greatest(0, least(255, trunc(fy + 1.772::FLOAT * fb)::INT)) AS b FROM f""")
def ycbcr_to_rgb(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("cast(l_partkey % 256 AS int) AS y", "cast(l_suppkey * 7 % 256 AS int) AS cb", "cast(l_orderkey * 3 % 256 AS int) AS cr").distinct()
    return rows.withColumn("rgb", K.ycbcr_to_rgb(F.col("y"), F.col("cb"), F.col("cr"))).select("y", "cb", "cr", "rgb.*")


@query("chroma_upsample", f"WITH {X.D3_SQL}, p AS (SELECT slide, cx, cy, pixels, unnest(range(240)) AS i FROM d3) SELECT slide, cx, cy, md5(string_agg(pixels[least((i // 16) * 8 // 15, 7) * 8 + least(i % 16 * 8 // 16, 7) + 1]::VARCHAR, ',' ORDER BY i)) AS plane_md5 FROM p GROUP BY slide, cx, cy")
def chroma_upsample(spark, sf_dir):
    plane = K.chroma_upsampled(F.col("pixels"), 8, 8, 16, 15)
    return X.gray_tiles(spark, sf_dir).select("slide", "cx", "cy", F.md5(F.array_join(F.transform(plane, lambda v: v.cast("string")), ",").cast("binary")).alias("plane_md5"))


def _resize_sql(name: str, size: int, out: int) -> str:
    rows = K.kernel_weights(name, size, out)
    cells = []
    for y in range(out):
        for x in range(out):
            total = " + ".join(["0.0::DOUBLE", *(f"pixels[{ky * size + kx + 1}] * {wy * wx!r}::DOUBLE" for ky, wy in rows[y] for kx, wx in rows[x])])
            cells.append(f"greatest(0, least(255, floor({total} + 0.5)::INT))")
    return "[" + ", ".join(cells) + "]"


_RESIZED = ["nearest", "triangle", "catmullrom", "lanczos3"]


@query("resize_kernels", f"WITH {X.D3_SQL} " + " UNION ALL ".join(f"SELECT slide, cx, cy, '{k}' AS kernel, list_sum({_resize_sql(k, 8, 3)})::BIGINT AS total FROM d3" for k in _RESIZED))
def resize_kernels(spark, sf_dir):
    rows, out = X.gray_tiles(spark, sf_dir), None
    for k in _RESIZED:
        one = rows.select("slide", "cx", "cy", F.lit(k).alias("kernel"), F.aggregate(K.resized(F.col("pixels"), 8, 3, k), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


@query("pyramid_box_mean", f"WITH {X.D3_SQL}, p AS (SELECT slide, cx, cy, pixels, unnest(range(16)) AS i FROM d3), m AS (SELECT *, (i // 4) * 16 + i % 4 * 2 AS a FROM p) SELECT slide, cx, cy, i::INT AS i, ((pixels[a + 1] + pixels[a + 2] + pixels[a + 9] + pixels[a + 10] + 2) // 4)::INT AS value FROM m")
def pyramid_box_mean(spark, sf_dir):
    return X.gray_tiles(spark, sf_dir).select("slide", "cx", "cy", F.posexplode(K.box_halved(F.col("pixels"), 8)).alias("i", "value"))


#: A wide-gamut matrix profile, to sRGB primaries.
_MATRIX = [[1.3984, -0.3984, 0.0], [0.0, 1.0, 0.0], [0.0, -0.0429, 1.0429]]


def _bake_sql(row: list[float]) -> str:
    v = "least(greatest(" + " + ".join(f"power({c} / 255.0::DOUBLE, 2.2::DOUBLE) * {m!r}::DOUBLE" for c, m in zip(("y", "cb", "cr"), row)) + ", 0), 1)"
    return f"floor(CASE WHEN {v} <= 0.0031308 THEN {v} * 12.92::DOUBLE ELSE power({v}, {1 / 2.4!r}::DOUBLE) * 1.055::DOUBLE - 0.055::DOUBLE END * 255 + 0.5)::INT"


@query("icc_matrix_bake", "WITH v AS (SELECT DISTINCT (l_partkey % 256)::INT AS y, (l_suppkey * 7 % 256)::INT AS cb, (l_orderkey * 3 % 256)::INT AS cr FROM lineitem) SELECT y, cb, cr, " + ", ".join(f"{_bake_sql(r)} AS {c}" for r, c in zip(_MATRIX, "rgb")) + " FROM v")
def icc_matrix_bake(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("cast(l_partkey % 256 AS int) AS y", "cast(l_suppkey * 7 % 256 AS int) AS cb", "cast(l_orderkey * 3 % 256 AS int) AS cr").distinct()
    return rows.withColumn("rgb", K.matrix_bake(F.col("y"), F.col("cb"), F.col("cr"), _MATRIX, 2.2)).select("y", "cb", "cr", "rgb.*")


@query("resample_tiles", _QUADS + """, c AS (SELECT slide, oc, orow, unnest(range(64)) AS i, q0, q1, q2, q3 FROM q), a AS (SELECT *, [(i // 8) * 2 * 16 + i % 8 * 2 + d FOR d IN [0, 1, 16, 17]] AS spots FROM c),
v AS (SELECT slide, oc, orow, i, list_sum([coalesce((CASE (k // 16 // 8) * 2 + (k % 16) // 8 WHEN 0 THEN q0 WHEN 1 THEN q1 WHEN 2 THEN q2 ELSE q3 END)[(k // 16) % 8 * 8 + (k % 16) % 8 + 1], 0) FOR k IN spots]) AS s FROM a)
SELECT slide, oc, orow, md5(string_agg(((s + 2) // 4)::INT::VARCHAR, ',' ORDER BY i)) AS tile_md5 FROM v GROUP BY ALL""")
def resample_tiles(spark, sf_dir):
    """Each 2 x 2 block of tiles, on one canvas, halved: the tiles are halved first, so a quarter of the bytes is shuffled."""
    halves = X.gray_tiles(spark, sf_dir).withColumn("pixels", K.box_halved(F.col("pixels"), 8))
    tile = K.quad_canvas(F.col("quad"), 4)
    return T.quads(halves, ["slide"], "pixels").select("slide", "oc", "orow", F.md5(F.array_join(F.transform(tile, lambda v: v.cast("string")), ",").cast("binary")).alias("tile_md5"))


# ledger


@query("ledger_status", """WITH b AS (SELECT p_partkey AS slide, ['dicom', 'tiff', 'vsi', 'mirax'][p_partkey % 4 + 1] AS format, (p_size - 2) / 40.0::DOUBLE AS m, p_size % 9 = 0 AS done FROM part)
SELECT slide, CASE WHEN done THEN 'SKIP' WHEN m > 0 AND m < 0.7 THEN 'OK' WHEN format = 'dicom' THEN 'SKIP' ELSE 'FAIL' END AS status, CASE WHEN done THEN 'output already exists' WHEN m > 0 AND m < 0.7 THEN NULL ELSE 'resolution unknown or too coarse for 20x' END AS reason FROM b""")
def ledger_status(spark, sf_dir):
    fmt = F.element_at(F.array(*map(F.lit, ["dicom", "tiff", "vsi", "mirax"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    usable = factor_to_20x((F.col("p_size") - 2) / 40.0).isNotNull()
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slide"), L.outcome(fmt, usable, F.col("p_size") % 9 == 0).alias("o")).select("slide", "o.*")


@query("run_summary", f"WITH {X.D6_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'OK') AS ok, count(*) FILTER (WHERE status = 'FAIL') AS fail, count(*) FILTER (WHERE status = 'SKIP') AS skip, coalesce(sum(in_bytes) FILTER (WHERE status = 'OK'), 0)::BIGINT AS in_bytes, coalesce(sum(out_bytes) FILTER (WHERE status = 'OK'), 0)::BIGINT AS out_bytes, round(CASE WHEN sum(in_bytes) FILTER (WHERE status = 'OK') > 0 THEN (sum(out_bytes) FILTER (WHERE status = 'OK'))::DOUBLE / (sum(in_bytes) FILTER (WHERE status = 'OK'))::DOUBLE * 100 ELSE 0 END, 6) AS ratio FROM d6")
def run_summary(spark, sf_dir):
    return L.summary(X.outcomes(spark, sf_dir))


@query("log_lines", f"WITH {X.D6_SQL} SELECT slide, rpad(status, 4, ' ') || ' (' || CASE WHEN length(slide::VARCHAR) < 4 THEN lpad(slide::VARCHAR, 4, ' ') ELSE slide::VARCHAR END || ') ' || rpad('slide-' || slide, 52, ' ') || '  ' || CASE status WHEN 'OK' THEN 'in=' || in_bytes || ' out=' || out_bytes WHEN 'FAIL' THEN 'conversion failed' ELSE '(output already exists)' END AS line FROM d6")
def log_lines(spark, sf_dir):
    reason = F.when(F.col("status") == "FAIL", "conversion failed").when(F.col("status") == "SKIP", "output already exists")
    name = F.concat(F.lit("slide-"), F.col("slide").cast("string"))
    return X.outcomes(spark, sf_dir).select("slide", L.log_line(F.col("status"), F.col("slide"), name, F.col("in_bytes"), F.col("out_bytes"), reason).alias("line"))
