"""Further queries: names, audits in full, plans, listings by rule, pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.functions.expressions import grouped, overwritten
from tesselon.operators import audit, geometry, kernels, labels, pairs, pixels, scores
from tesselon.plans.catalog import BOXES, DETECTIONS, FILES, IMAGES, PIXELS, with_size
from tesselon.plans.registry import query
from tesselon.sources import sinks, tables

NAMES = "names as (select range as cls_id, 'c' || range as class_name from range(150))"


# --- names ---------------------------------------------------------------------------------------


@query(f"with {BOXES}, {NAMES} select coalesce(class_name, 'OUT OF RANGE') as class_name, count(*) as n from boxes left join names using (cls_id) group by 1")
def named_histogram(spark: SparkSession, d: str) -> DataFrame:
    return labels.named(tables.boxes(spark, d), tables.class_names(spark)).groupBy("class_name").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {NAMES}, r as (select p_partkey, 'c' || p_size * 7 as class_name from part) select p_partkey, class_name, cls_id from r left join names using (class_name)")
def class_ids_by_name(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.table(spark, d, "part").select("p_partkey", F.concat(F.lit("c"), (F.col("p_size") * 7).cast("string")).alias("class_name"))
    return labels.ids_of(rows, tables.class_names(spark)).select("p_partkey", "class_name", "cls_id")


@query(f"with {BOXES}, {IMAGES}, {PIXELS} select i.image_id, p.cls_id, x1, y1, x2, y2 from images i left join pixels p using (image_id)")
def image_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Every image, boxes or not."""
    found = geometry.pixel_boxes(with_size(spark, d)).select("image_id", "cls_id", "x1", "y1", "x2", "y2")
    return labels.boxes_of_images(tables.images(spark, d).select("image_id"), found)


# --- audits --------------------------------------------------------------------------------------

COUNTS = f"with {BOXES}, {NAMES}, c as (select cls_id, class_name, count(*) as n from boxes join names using (cls_id) group by all)"


def _counts(spark: SparkSession, d: str) -> DataFrame:
    n = labels.histogram(tables.boxes(spark, d))
    return n.join(tables.class_names(spark), "cls_id").select("cls_id", "class_name", "n")


@query(f"{COUNTS} select *, repeat('█', least(n // 20, 30)::int) as bar from c order by n desc, cls_id limit 25")
def audit_top_classes(spark: SparkSession, d: str) -> DataFrame:
    return audit.with_bars(audit.top(_counts(spark, d), "n", "cls_id", 25), 20, most=30)


@query(f"{COUNTS} select *, repeat('█', greatest(n // 5, 1)::int) as bar from c order by n, cls_id desc limit 10")
def audit_bottom_classes(spark: SparkSession, d: str) -> DataFrame:
    return audit.with_bars(audit.bottom(_counts(spark, d), "n", "cls_id", 10), 5, least=1)


@query(f"with {BOXES} select image_id, cls_id from boxes where cls_id >= 150 order by image_id, cls_id limit 5")
def first_invalid_ids(spark: SparkSession, d: str) -> DataFrame:
    return audit.first(labels.invalid_ids(tables.boxes(spark, d)).select("image_id", "cls_id"), ["image_id", "cls_id"], 5)


@query(f"with {DETECTIONS} select name, format('{{:,}}', count(*) * 1000) as n_thousands, count(*) as n from detections group by name")
def grouped_counts(spark: SparkSession, d: str) -> DataFrame:
    n = tables.detections(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return n.select("name", grouped(F.col("n") * 1000).alias("n_thousands"), "n")


@query(f"with {DETECTIONS}, o as (select event_id % 1000 as image_id, event_id as place, name, conf, case when conf >= 0.8::double then 'sure' when conf >= 0.5 then 'doubtful' else 'poor' end as tier, repeat('█', floor(conf * 20)::int) as bar from detections where conf >= 0.25) select image_id, count(*) as n, string_agg(name || ' ' || bar || ' ' || tier, ';' order by place) as listed from o group by image_id")
def image_detections(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.detections(spark, d).where(F.col("conf") >= 0.25).select((F.col("event_id") % 1000).alias("image_id"), F.col("event_id").alias("place"), "name", "conf")
    return audit.detections_by_image(rows).select("image_id", "n", F.array_join(F.transform("found", lambda x: F.concat_ws(" ", x["name"], x["bar"], x["tier"])), ";").alias("listed"))


@query(f"with {FILES}, w as (select unnest(['en_web', 'de_web', 'en_books', 'xx_none']) as class_name), n as (select class as class_name, count(*) as n from files group by 1) select class_name, coalesce(n, 0) as n, repeat('█', least(coalesce(n, 0), 20)::int) as bar from w left join n using (class_name)")
def rare_class_availability(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([(x,) for x in ("en_web", "de_web", "en_books", "xx_none")], "class_name string")
    files = tables.files(spark, d).withColumnRenamed("class", "class_name")
    if files.join(wanted, "class_name", "left_semi").isEmpty():  # these sources need not exist
        return wanted.select("class_name", F.lit(0).cast("long").alias("n"), F.lit("").alias("bar"))
    return labels.availability(wanted, files)


@query(f"with {FILES}, s as (select f.doc_id, f.class, case when row_number() over (partition by class order by md5('42:' || f.doc_id), f.doc_id) <= greatest(1, floor(count(*) over (partition by class) * 0.2::double)) then 'val' else 'train' end as split from files f semi join labels using (doc_id)), c as (select class, count(*) as n, count(*) filter (where split = 'train') as train, count(*) filter (where split = 'val') as val from s group by 1) select class, n_files, coalesce(n, 0) as n, coalesce(train, 0) as train, coalesce(val, 0) as val, n_files - coalesce(n, 0) as no_label, coalesce(n, 0) = 0 as skipped from (select class, count(*) as n_files from files group by 1) left join c using (class)")
def split_counts_of_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.split_counts(tables.files(spark, d), tables.table(spark, d, "labels"), "class", "doc_id")


@query("select count(*) as n_moved, count(l.doc_id) as n_with_label, count(*) filter (where l.doc_id is null) as n_missing from (select doc_id from documents where doc_id % 5 = 1) d left join (select distinct doc_id from labels) l using (doc_id)")
def moved_labels(spark: SparkSession, d: str) -> DataFrame:
    return pairs.moved_with_labels(tables.table(spark, d, "documents").where("doc_id % 5 = 1"), tables.table(spark, d, "labels"), "doc_id")


@query("select case when o_orderkey % 5 = 0 then 'val' else 'train' end as split, count(*) as n_images from orders group by 1")
def images_per_split(spark: SparkSession, d: str) -> DataFrame:
    images = tables.images(spark, d).withColumn("split", F.when(F.col("image_id") % 5 == 0, "val").otherwise("train"))
    return images.groupBy("split").agg(F.count(F.lit(1)).alias("n_images"))


# --- rules on boxes and images -------------------------------------------------------------------


@query(f"with {BOXES}, f as (select image_id, bool_or(bw > 0.87 and bh > 0.87) as fallback, count(*) as n from boxes group by 1) select count(*) as n_images, count(*) filter (where fallback) as n_fallback, count(*) filter (where fallback) / greatest(count(*), 1) * 100 as pct from f")
def fallback_boxes(spark: SparkSession, d: str) -> DataFrame:
    f = tables.boxes(spark, d).groupBy("image_id").agg(F.bool_or(geometry.is_fallback(F.col("bw"), F.col("bh"))).alias("fallback"))
    n, k = F.count(F.lit(1)), F.count_if("fallback")
    return f.agg(n.alias("n_images"), k.alias("n_fallback"), (k / F.greatest(n, F.lit(1)) * 100).alias("pct"))


@query("select distinct class_name from (select lang || '_' || upper(source) as class_name from documents) where lower(class_name) = lower('EN_' || (select min(source) from documents where lang = 'en'))")
def folder_by_name(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.table(spark, d, "documents")
    folders = docs.select(F.concat("lang", F.lit("_"), F.upper("source")).alias("class_name")).distinct()
    only = docs.where("lang = 'en'").agg(F.min("source")).first()[0]
    return labels.same_folder(folders, f"EN_{only}")


ALLOWED = (9, 33, 120, 149, 7000)


@query(f"with {BOXES} select cls_id, count(*) as n from boxes where cls_id in {ALLOWED} group by 1")
def allowed_classes(spark: SparkSession, d: str) -> DataFrame:
    allowed = spark.createDataFrame([(x,) for x in ALLOWED], "cls_id long")
    return labels.histogram(pairs.on_list(tables.boxes(spark, d), allowed, "cls_id"))


@query("select event_type || '.jpg' as path from events where event_id % 2 = 0 union select event_type || '.jpg' from events where event_id % 3 = 0 union select event_type || '.png' from events")
def distinct_paths(spark: SparkSession, d: str) -> DataFrame:
    e = tables.table(spark, d, "events")
    of = lambda rows, suffix: rows.select(F.concat("event_type", F.lit(suffix)).alias("path"))
    return pairs.distinct_paths(of(e.where("event_id % 2 = 0"), ".jpg"), of(e.where("event_id % 3 = 0"), ".jpg"), of(e, ".png"))


@query(f"with {FILES}, c as (select class, row_number() over (order by class) as position from (select distinct class from files)) select row_number() over (order by position, doc_id)::int as place, class, doc_id from files join c using (class)")
def union_in_class_order(spark: SparkSession, d: str) -> DataFrame:
    files = tables.files(spark, d)
    classes = pairs.ranked(files.select("class").distinct(), None, F.col("class"), "position")
    return pairs.in_class_order(files, classes, "class", "doc_id").select(F.col("place").cast("int").alias("place"), "class", "doc_id")


@query(f"with {FILES}, o as (select class, count(*) as n from files where doc_id % 3 = 0 group by 1), w as (select class, stem, row_number() over (partition by class order by stem) as r from files where doc_id % 3 <> 0) select stem, class || '_aug_' || lpad((r + coalesce(n, 0))::varchar, 3, '0') as name from w left join o using (class)")
def numbers_continued(spark: SparkSession, d: str) -> DataFrame:
    files = tables.files(spark, d)
    rows = pairs.numbered_on(files.where("doc_id % 3 <> 0"), files.where("doc_id % 3 = 0"), "class", "stem")
    return rows.select("stem", F.format_string("%s_aug_%03d", "class", "number").alias("name"))


@query(f"with {IMAGES} select image_id from images where width < 100 or height < 100")
def delete_small(spark: SparkSession, d: str) -> DataFrame:
    return sinks.delete_plan(tables.images(spark, d), F.expr("width >= 100 and height >= 100"), "image_id")


@query(f"with {IMAGES}, s as (select *, 212::double / greatest(width, height) as scale from images), n as (select image_id, trunc(width * scale)::int as new_w, trunc(height * scale)::int as new_h from s) select *, floor((224 - new_w) / 2)::int as off_x, floor((224 - new_h) / 2)::int as off_y, 'lanczos' as method, case when new_w < 1 or new_h < 1 then 'reject' else 'resize' end as status from n")
def letterbox_plan_always(spark: SparkSession, d: str) -> DataFrame:
    return geometry.letterbox_always(tables.images(spark, d))


@query(f"with {IMAGES} select image_id, 224 as new_w, 224 as new_h, round(224::double / width, 9) as x_factor, round(224::double / height, 9) as y_factor from images")
def stretch_plan(spark: SparkSession, d: str) -> DataFrame:
    return geometry.stretch(tables.images(spark, d)).withColumns({c: F.round(c, 9) for c in ("x_factor", "y_factor")})


@query(f"with {BOXES}, {IMAGES}, {PIXELS}, a as (select *, (x2 - x1) * (y2 - y1) / (width * height) as share from pixels), k as (select *, case when share > 0.95 then 'whole' when share < 0.01 then 'fallback' else 'sign' end as kind from a) select image_id, kind, case when kind = 'sign' then x1 else 0 end as x1, case when kind = 'sign' then y1 else 0 end as y1, case when kind = 'sign' then x2 else width end as x2, case when kind = 'sign' then y2 else height end as y2 from k")
def content_regions(spark: SparkSession, d: str) -> DataFrame:
    return geometry.content_region(geometry.pixel_boxes(with_size(spark, d))).select("image_id", "kind", "x1", "y1", "x2", "y2")


ANCHORS = "(floor(size / 8)::bigint * floor(size / 8)::bigint + floor(size / 16)::bigint * floor(size / 16)::bigint + floor(size / 32)::bigint * floor(size / 32)::bigint)"


@query(f"with s as (select p_partkey, (p_size + 1) * 32 as size, 154 + (p_partkey % 2) as channels from part) select p_partkey, {ANCHORS} as n_anchors, channels = 154 and {ANCHORS} % 21 = 0 as fits from s")
def anchor_counts(spark: SparkSession, d: str) -> DataFrame:
    s = tables.table(spark, d, "part").select("p_partkey", ((F.col("p_size") + 1) * 32).alias("size"), (154 + F.col("p_partkey") % 2).alias("channels"))
    n = geometry.anchors(F.col("size"))
    return s.select("p_partkey", n.alias("n_anchors"), geometry.output_fits(F.col("channels"), n - n % 21, 150, F.col("size")).alias("fits"))


@query(f"with {IMAGES} select case when width <= 224 then 3 else 1 end as scale, count(*) as n, sum(width * case when width <= 224 then 3 else 1 end)::bigint as drawn_width from images group by 1")
def draw_scales(spark: SparkSession, d: str) -> DataFrame:
    s = tables.images(spark, d).withColumn("scale", geometry.draw_scale(F.col("width")))
    return s.groupBy("scale").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("width") * F.col("scale")).alias("drawn_width"))


@query("select r_regionkey, '/data' as path, '150' as nc, 'images/val' as val, r_name as names from region")
def config_overwritten(spark: SparkSession, d: str) -> DataFrame:
    old = F.create_map(F.lit("path"), F.lit("/old"), F.lit("nc"), F.lit("151"), F.lit("val"), F.lit("images/val"), F.lit("names"), F.col("r_name"))
    new = tables.table(spark, d, "region").select("r_regionkey", overwritten(old, path="/data", nc=150).alias("m"))
    return new.select("r_regionkey", *(F.col("m")[k].alias(k) for k in ("path", "nc", "val", "names")))


# --- pixels --------------------------------------------------------------------------------------

GRAY = "px as (select vec_id, unnest(generate_series(0, 63)) as pos, unnest(list_transform(embedding, lambda v: ((round(v::double * 1000)::bigint % 256) + 256) % 256)) as value from embeddings)"
SHARES = "r as (select vec_id, 'row' as line, (pos // 8)::int as at, avg((value > 20)::int) as share from px group by all union all select vec_id, 'column', (pos % 8)::int, avg((value > 20)::int) from px group by all), s as (select * from r where share >= 0.95)"


@query(f"with {GRAY}, {SHARES} select * from s")
def content_lines(spark: SparkSession, d: str) -> DataFrame:
    return scores.content_shares(tables.pixels(spark, d), "vec_id", 8, 20, 0.95)


@query(f"with {GRAY}, {SHARES} select vec_id, line, min(\"at\") as first_at, max(\"at\") as last_at, count(*) as n from s group by all")
def content_extents(spark: SparkSession, d: str) -> DataFrame:
    return scores.content_extent(scores.content_shares(tables.pixels(spark, d), "vec_id", 8, 20, 0.95), "vec_id")


@query(f"with {GRAY} select vec_id, sum(case when value > 127 then 255 else 0 end) / 255 as score from px group by 1")
def mask_scores(spark: SparkSession, d: str) -> DataFrame:
    return scores.mask_score(tables.pixels(spark, d).withColumn("value", F.when(F.col("value") > 127, 255).otherwise(0)), "vec_id")


def _kernel(name: str, kernel, sql: str) -> None:
    """Registers a query: vec_id with the sum and a weighted sum of an image's values after a kernel of (px, width, height)."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = tables.gray_arrays(spark, d).withColumn("px", kernel(F.col("px"), F.col("width"), F.col("height")))
        add = lambda s, x: s + x
        return rows.select("vec_id", F.aggregate("px", F.lit(0).cast("long"), add).alias("total"), F.aggregate(F.transform("px", lambda v, i: v * (i + 1).cast("long")), F.lit(0).cast("long"), add).alias("weighted"))

    run.__name__ = name
    query(f"with {GRAY}, {sql} select vec_id, sum(value)::bigint as total, sum(value * (pos + 1))::bigint as weighted from out group by 1")(run)


_kernel("kernel_brightness", lambda px, w, h: pixels.brightness(px, 1.25, -10), "out as (select vec_id, pos, least(round_even(abs(value * 1.25::double - 10), 0), 255) as value from px)")
_kernel("kernel_shadow", lambda px, w, h: pixels.shadow(px, w, 1, 3, 0.12), "out as (select vec_id, pos, least(round_even(value + case when pos % 8 >= 3 then 20 * 0.12::double else 0 end, 0), 255) as value from px)")
NEAR = "from px a join px b on a.vec_id = b.vec_id and abs(a.pos // 8 - b.pos // 8) <= 1 and abs(a.pos % 8 - b.pos % 8) <= 1 group by 1, 2"
_kernel("kernel_erosion", lambda px, w, h: pixels.eroded(px, w, h, 1), f"out as (select a.vec_id, a.pos, min(b.value) as value {NEAR})")
_kernel("kernel_dilation", lambda px, w, h: pixels.dilated(px, w, h, 1), f"out as (select a.vec_id, a.pos, max(b.value) as value {NEAR})")
_kernel("kernel_halving", lambda px, w, h: pixels.reduced(px, w, h, 1, 2), "out as (select vec_id, pos // 16 * 4 + pos % 8 // 2 as pos, round_even(avg(value), 0) as value from px group by all)")
MIRROR = "case when abs({0}) % 14 < 8 then abs({0}) % 14 else 14 - abs({0}) % 14 end"
_kernel("kernel_blur", lambda px, w, h: pixels.blurred(px, w, h, 1, 0.6), f"""k as (select exp(-0.5::double * pow(1 / 0.6::double, 2)) as e), t as (select unnest([-1, 0, 1]) as d, unnest([e / (e + 1 + e), 1 / (e + 1 + e), e / (e + 1 + e)]) as t from k),
    v as (select a.vec_id, a.pos, sum(t * b.value) as value from px a, t join px b on b.vec_id = a.vec_id and b.pos = ({MIRROR.format("(a.pos // 8 + d)")}) * 8 + a.pos % 8 group by all),
    out as (select a.vec_id, a.pos, round_even(sum(t * b.value), 0) as value from v a, t join v b on b.vec_id = a.vec_id and b.pos = a.pos // 8 * 8 + ({MIRROR.format("(a.pos % 8 + d)")}) group by all)""")
_kernel("kernel_rotation", lambda px, w, h: pixels.rotated(px, w, h, 1, 2.5), f"""s as (select vec_id, pos, cos(radians(2.5)) * (pos % 8 - 4) - sin(radians(2.5)) * (pos // 8 - 4) + 4 as sx, sin(radians(2.5)) * (pos % 8 - 4) + cos(radians(2.5)) * (pos // 8 - 4) + 4 as sy from px),
    f as (select vec_id, pos, sx - floor(sx) as fx, sy - floor(sy) as fy, floor(sx)::bigint as x0, floor(sy)::bigint as y0 from s), g as (select vec_id, list(value order by pos) as l from px group by 1),
    q as (select vec_id, pos, fx, fy, {", ".join(f"l[({MIRROR.format(f'(y0 + {j})')}) * 8 + ({MIRROR.format(f'(x0 + {i})')}) + 1] as v{i}{j}" for i in (0, 1) for j in (0, 1))} from f join g using (vec_id)),
    out as (select vec_id, pos, round_even((v00 * (1 - fx) + v10 * fx) * (1 - fy) + (v01 * (1 - fx) + v11 * fx) * fy, 0) as value from q)""")
DRAW = "(('0x' || substr(md5({}), 1, 8))::bigint::double + 0.5::double) / 4294967296"
ITEM = "'42:' || vec_id || ':' || pos || ':{0}'"
NOISE = f"n as (select vec_id, pos, value, trunc(5 * sqrt(-2 * ln({DRAW.format(ITEM.format('a'))})) * cos(2 * pi() * {DRAW.format(ITEM.format('b'))})) as e from px), out as (select vec_id, pos, least(greatest(value + e, 0), 255) as value from n)"


@query(f"""with {GRAY}, {NOISE} select vec_id, sum(value)::bigint as total, sum(value * (pos + 1))::bigint as weighted from out group by 1""")
def kernel_noise(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.gray_arrays(spark, d).withColumn("px", pixels.noisy(F.col("px"), F.col("vec_id"), 5.0))
    return _summed(rows)


SPOT = "floor((('0x' || substr(md5('42:' || vec_id || ':{0}:' || k), 1, 8))::bigint::double + 0.5::double) / 4294967296 * 8 * 8)::bigint"


@query(f"""with {GRAY}, d as (select vec_id, k, {SPOT.format("salt")} as s, {SPOT.format("pepper")} as p from embeddings, (select unnest([1, 2, 3]) as k)), out as (select vec_id, pos, case when exists (select 1 from d where d.vec_id = px.vec_id and p = pos) then 0
    when exists (select 1 from d where d.vec_id = px.vec_id and s = pos) then 255 else value end as value from px) select vec_id, sum(value)::bigint as total, sum(value * (pos + 1))::bigint as weighted from out group by 1""")
def kernel_dots(spark: SparkSession, d: str) -> DataFrame:
    """Three white and three black dots in each image."""
    rows = tables.gray_arrays(spark, d).withColumn("px", pixels.salt_and_pepper(F.col("px"), F.col("width"), F.col("height"), 1, F.col("vec_id"), 0.1))
    return _summed(rows)


SAMPLED = f"""f as (select vec_id, pos, sx - floor(sx) as fx, sy - floor(sy) as fy, floor(sx)::bigint as x0, floor(sy)::bigint as y0 from s), g as (select vec_id, list(value order by pos) as l from px group by 1),
    q as (select vec_id, pos, fx, fy, {", ".join(f"l[({MIRROR.format(f'(y0 + {j})')}) * 8 + ({MIRROR.format(f'(x0 + {i})')}) + 1] as v{i}{j}" for i in (0, 1) for j in (0, 1))} from f join g using (vec_id)),
    out as (select vec_id, pos, round_even((v00 * (1 - fx) + v10 * fx) * (1 - fy) + (v01 * (1 - fx) + v11 * fx) * fy, 0) as value from q)"""
FIELD = "'42:' || vec_id || ':{0}:' || pos % 8 || ':' || pos // 8"
SUMMED = "select vec_id, sum(value)::bigint as total, sum(value * (pos + 1))::bigint as weighted from out group by 1"


def _summed(rows: DataFrame) -> DataFrame:
    """vec_id with the sum and a weighted sum of px."""
    return rows.select("vec_id", F.expr("aggregate(px, 0L, (s, x) -> s + x)").alias("total"), F.expr("aggregate(transform(px, (v, i) -> v * (i + 1)), 0L, (s, x) -> s + x)").alias("weighted"))


@query(f"""with {GRAY}, u as (select vec_id, pos, {DRAW.format(FIELD.format("x"))} * 2 - 1 as ux, {DRAW.format(FIELD.format("y"))} * 2 - 1 as uy from px), w as (select range - 20 as d, exp(-0.5::double * pow((range - 20) / 5.0::double, 2)) as e from range(41)),
    t as (select d, e / sum(e) over () as t from w), a as (select a.vec_id, a.pos, sum(t * b.ux) as ux, sum(t * b.uy) as uy from u a, t join u b on b.vec_id = a.vec_id and b.pos = ({MIRROR.format("(a.pos // 8 + d)")}) * 8 + a.pos % 8 group by all),
    b as (select a.vec_id, a.pos, sum(t * b.ux) as ux, sum(t * b.uy) as uy from a, t join a b on b.vec_id = a.vec_id and b.pos = a.pos // 8 * 8 + ({MIRROR.format("(a.pos % 8 + d)")}) group by all),
    s as (select vec_id, pos, least(greatest(pos % 8 + ux * 6, 0), 7) as sx, least(greatest(pos // 8 + uy * 6, 0), 7) as sy from b), {SAMPLED} {SUMMED}""")
def kernel_elastic(spark: SparkSession, d: str) -> DataFrame:
    return _summed(tables.gray_arrays(spark, d).withColumn("px", pixels.elastic(F.col("px"), F.col("width"), F.col("height"), 1, F.col("vec_id"), 6.0, 5.0)))


@query(f"with {GRAY}, out as (select vec_id, pos, round_even(value * 0.92::double + floor({DRAW.format("'42:' || vec_id || ':grain:0:0'")} * 25) * 0.08::double, 0) as value from px) {SUMMED}")
def kernel_grain(spark: SparkSession, d: str) -> DataFrame:
    """A texture on each image; at this size it has a single value."""
    return _summed(tables.gray_arrays(spark, d).withColumn("px", pixels.grained(F.col("px"), F.col("width"), F.col("height"), 1, F.col("vec_id"))))


@query(f"""with {GRAY}, e as (select vec_id, value from px where pos // 8 in (0, 7) union all select vec_id, value from px where pos % 8 in (0, 7)), m as (select vec_id, trunc(median(value)) as colour from e group by 1),
    c as (select vec_id, colour, range as pos, range % 24 as x, range // 24 as y from m, range(576)), out as (select c.vec_id, c.pos, coalesce(p.value, colour) as value from c left join px p on p.vec_id = c.vec_id and x between 2 and 21 and y between 2 and 21 and p.pos = (y - 2) * 8 // 20 * 8 + (x - 2) * 8 // 20) {SUMMED}""")
def kernel_letterbox(spark: SparkSession, d: str) -> DataFrame:
    """Images of 8 x 8 on squares of 24 with a margin of 2."""
    return _summed(tables.gray_arrays(spark, d).withColumn("px", pixels.letterboxed(F.col("px"), F.col("width"), F.col("height"), 1, 24, 2)))


RING = "x >= x1 - {0} and x < 6 + {1} and y >= 1 - {0} and y < y2 + {1}"


@query(f"""with {GRAY}, b as (select vec_id, vec_id % 3 as x1, 4 + vec_id % 2 as y2, vec_id % 5 = 0 as bare, case when vec_id % 2 = 0 then 80 else 200 end as ink from embeddings), p as (select *, pos % 8 as x, pos // 8 as y from px join b using (vec_id)),
    out as (select vec_id, pos, case when bare then case when y < 4 then 80 else value end when {RING.format(1, 1)} and not ({RING.format(-1, -1)}) then ink else value end as value from p) {SUMMED}""")
def kernel_frames(spark: SparkSession, d: str) -> DataFrame:
    """A frame round a box on each image, the mark of a missing box on every fifth."""
    k = F.col("vec_id")
    box = F.struct((k % 3).alias("x1"), F.lit(1).alias("y1"), F.lit(6).alias("x2"), (4 + k % 2).alias("y2"), (k % 2 == 0).alias("suspicious"))
    rows = tables.gray_arrays(spark, d).withColumn("boxes", F.filter(F.array(box), lambda _: k % 5 != 0))
    return _summed(rows.withColumn("px", pixels.framed(F.col("px"), F.col("width"), F.col("height"), 1, F.col("boxes"), [200], [80])))


@query(f"""with {BOXES}, n as (select count(*) as n from orders), r as (select o_orderkey as image_id, row_number() over (order by o_orderkey) - 1 as rank from orders),
    s as (select m.range as mosaic, t.range as slot, (('0x' || substr(md5('42:' || m.range || ':' || t.range), 1, 8))::bigint) % n as rank from range(20) m, range(64) t, n)
    select mosaic, slot, cls_id, round(least(greatest(slot % 8 * 0.125 + xc * 0.125, 0), 1), 9) as nx, round(least(greatest(slot // 8 * 0.125 + yc * 0.125, 0), 1), 9) as ny, round(least(greatest(bw * 0.125, 0.001), 1), 9) as nw, round(least(greatest(bh * 0.125, 0.001), 1), 9) as nh
    from s join r using (rank) join boxes using (image_id) where image_id % 7 <> 0""")
def mosaic_labels(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of 20 mosaics of random images, of which every seventh cannot be read."""
    slots = spark.range(20 * 64).select(F.floor(F.col("id") / 64).alias("mosaic"), (F.col("id") % 64).alias("slot"))
    tiles = pairs.drawn(tables.images(spark, d).select("image_id"), "image_id", slots).withColumn("px", F.when(F.col("image_id") % 7 != 0, F.array(F.lit(0))))
    found = pixels.mosaic_labels(tiles, tables.boxes(spark, d), "mosaic", "image_id", 8, 640)
    return found.select("mosaic", "slot", "cls_id", *(F.round(c, 9).alias(c) for c in ("nx", "ny", "nw", "nh")))


@query()
def augmented_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Each image after the whole chain as array expressions: what is drawn depends on its key, and tests hold the steps against plain versions."""
    return _summed(pixels.augmented(tables.gray_arrays(spark, d), "vec_id", 1))


@query(f"with {GRAY}, out as (select vec_id, (pos // 8 + 8 * t) * 16 + pos % 8 + 8 * t as pos, value from px, (values (0), (1)) as v(t)) select vec_id, sum(value)::bigint as total, sum(value * (pos + 1))::bigint as weighted from out group by 1")
def kernel_mosaic(spark: SparkSession, d: str) -> DataFrame:
    """Each image twice on a mosaic of 2 x 2, from corner to corner."""
    slots = tables.gray_arrays(spark, d).select("vec_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(3))).alias("slot"), F.when(F.col("slot") != 1, F.col("px")).alias("px"))
    return _summed(pixels.mosaics(slots, "vec_id", 2, 8, 1))


@query(f"with {GRAY} select vec_id, 3::bigint as channels, round(sum((value / 255)::float::double * 3), 4) as total from px group by 1")
def channels_first(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.gray_arrays(spark, d).withColumn("px", F.flatten(F.transform("px", lambda v: F.array_repeat(v, 3))))
    out = pixels.channels_first(F.col("px"), F.col("width"), F.col("height"), 3)
    return rows.select("vec_id", F.lit(3).cast("long").alias("channels"), F.round(F.aggregate(out, F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@query()
def augmented(spark: SparkSession, d: str) -> DataFrame:
    """Each image after the augmentation chain, 32 pixels wide: random, so tests hold its parts against brute force."""
    return kernels.over_images(tables.gray_images(spark, d), lambda img, r: kernels.augment(kernels.resize(img, 32, 32, "linear"), r), "image", key="vec_id", spread=spark.sparkContext.defaultParallelism)


@query()
def regions(spark: SparkSession, d: str) -> DataFrame:
    """The box that region detection finds in each image."""
    return kernels.over_images(tables.gray_images(spark, d), lambda img, _: kernels.region(kernels.resize(img, 64, 64, "linear")), "xc double, yc double, w double, h double", key="vec_id", spread=spark.sparkContext.defaultParallelism)


@query()
def line_masks(spark: SparkSession, d: str) -> DataFrame:
    """Scores of horizontal and vertical lines, and the layout they give."""
    found = kernels.over_images(tables.gray_images(spark, d), lambda img, _: kernels.line_scores(kernels.resize(img, 64, 64, "nearest")), "h long, v long", key="vec_id", spread=spark.sparkContext.defaultParallelism)
    return found.withColumn("layout", geometry.layout(F.col("h"), F.col("v")))


@query()
def letterboxed(spark: SparkSession, d: str) -> DataFrame:
    """Images of 8 x 8 on squares of 24 with a margin of 2, then with contrast equalised by tiles."""
    return kernels.over_images(tables.gray_images(spark, d), lambda img, _: kernels.clahe(kernels.letterbox(img, 24, 2)), "image", key="vec_id", spread=spark.sparkContext.defaultParallelism)


@query(f"with {BOXES}, l as (select image_id, printf('%d %.6f %.6f %.6f %.6f', cls_id, xc, yc, bw, bh) || chr(10) as line, cls_id, xc, yc, bw, bh from boxes) select image_id, string_agg(line, '' order by cls_id, xc, yc, bw, bh) as content from l group by 1")
def label_texts(spark: SparkSession, d: str) -> DataFrame:
    """The content of each image's label file; the bag of boxes has no order, so it is put in one."""
    b = tables.boxes(spark, d)
    return sinks.label_files(b.withColumn("line_no", F.struct("cls_id", "xc", "yc", "bw", "bh")))
