"""Named queries over the standard tables, each with the same result in SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.functions.expressions import bar, batch_for_device, rescaled, tier
from tesselon.operators import audit, geometry, labels, lexicon, pairs, scores
from tesselon.plans.registry import ORACLE_SQL, QUERIES, query
from tesselon.sources import tables

__all__ = ["ORACLE_SQL", "QUERIES"]

# Fixed pieces of the SQL side: the adapters as common table expressions.
BOXES = "boxes as (select l_orderkey as image_id, l_partkey % 155 as cls_id, l_quantity / 51 as xc, (l_suppkey % 97) / 97 as yc, l_discount * 10 as bw, l_tax * 12.5 as bh from lineitem)"
IMAGES = "images as (select o_orderkey as image_id, 80 + o_orderkey * 7919 % 1200 as width, 80 + o_orderkey * 104729 % 1200 as height from orders)"
FILES = "files as (select doc_id, lang || '_' || source as class, lang || '_' || source || '_' || doc_id as stem from documents)"
LINES = "label_lines as (select l_orderkey as image_id, l_linenumber as line_no, l_partkey % 155 as cls_id, case when l_linenumber = 7 then 4 when l_linenumber = 6 then 6 else 5 end as n_tokens from lineitem)"
DETECTIONS = "detections as (select event_id, event_type as name, event_id * 37 % 101 / 100.0::double as conf from events)"
SCORES = "scores as (select vec_id as anchor, unnest(embedding) as score, generate_subscripts(embedding, 1) - 1 as cls from embeddings)"
TRUTH = "truth as (select label as row_label, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 as col_label from embeddings)"


#: A class counts as low under so many instances here, where the mean is some hundreds.
LOW = 300


def with_size(spark: SparkSession, d: str) -> DataFrame:
    return tables.boxes(spark, d).join(tables.images(spark, d), "image_id")


@query(f"with {BOXES} select cls_id, count(*) as n from boxes group by cls_id")
def class_histogram(spark: SparkSession, d: str) -> DataFrame:
    return labels.histogram(tables.boxes(spark, d))


@query(f"with {BOXES} select r.range as cls_id, count(b.cls_id) as n from range(160) r left join boxes b on b.cls_id = r.range group by 1")
def histogram_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    return labels.zero_filled(tables.boxes(spark, d), 160)


@query(f"with {BOXES}, c as (select r.range as cls_id, count(b.cls_id) as n from range(160) r left join boxes b on b.cls_id = r.range group by 1) select *, case when n = 0 then 'zero' when n < 390 then 'low' else 'ok' end as level from c")
def low_classes(spark: SparkSession, d: str) -> DataFrame:
    return audit.class_levels(labels.zero_filled(tables.boxes(spark, d), 160), 390)


def _health_sql(group: str) -> str:
    of = "image_id, case when image_id % 5 = 0 then 'val' else 'train' end as split" if group else "image_id, 1 as split"
    sql = f"""with {LINES}, {IMAGES}, i as (select {of} from images), f as (select i.*, s.image_id is null as empty from i left join (select distinct image_id from label_lines) s using (image_id) where s.image_id is not null or i.image_id % 3 <> 0),
        c as (select split, cls_id, count(*) as n from label_lines join i using (image_id) where n_tokens >= 5 group by all),
        k as (select split, coalesce(sum(n) filter (where cls_id < 150), 0)::bigint as n_instances, coalesce(sum(n) filter (where cls_id >= 150), 0)::bigint as n_invalid, coalesce(sum(n) filter (where cls_id = 120), 0)::bigint as n_unknown, count(*) filter (where cls_id < 150 and n < {LOW}) as n_low, 150 - count(*) filter (where cls_id < 150) as n_zero from c group by split),
        a as (select split, count(*) as n_images from i group by split), b as (select split, count(*) as n_label_files, count(*) filter (where empty) as n_empty from f group by split)
        select *, n_instances / greatest(n_label_files, 1) as avg_per_file, n_unknown / greatest(n_instances, 1) * 100 as unknown_pct, n_unknown / greatest(n_instances, 1) * 100 > 10 as unknown_warning from a join b using (split) join k using (split)"""
    return sql if group else sql.replace("select *, n_inst", "select * exclude (split), n_inst")


def _health(spark: SparkSession, d: str, group: str | None) -> DataFrame:
    images = tables.images(spark, d).withColumn("split", F.when(F.col("image_id") % 5 == 0, "val").otherwise("train"))
    return audit.health(images, tables.label_files(spark, d), labels.line_classes(tables.label_lines(spark, d)), low=LOW, group=group)


@query(_health_sql(""))
def health_audit(spark: SparkSession, d: str) -> DataFrame:
    return _health(spark, d, None)


@query(_health_sql("split"))
def health_audit_by_split(spark: SparkSession, d: str) -> DataFrame:
    return _health(spark, d, "split")


@query(f"select null::varchar as split, * from ({_health_sql('')}) union all by name select * from ({_health_sql('split')})")
def health_audit_in_all(spark: SparkSession, d: str) -> DataFrame:
    """Both audits from one pass; the row without a split is that of all."""
    images = tables.images(spark, d).withColumn("split", F.when(F.col("image_id") % 5 == 0, "val").otherwise("train"))
    return audit.health_in_all(images, tables.label_files(spark, d), labels.line_classes(tables.label_lines(spark, d)), "split", low=LOW)


def _rule(name: str, rule: str, test: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return labels.parse_lines(tables.label_lines(spark, d), rule).groupBy("cls_id", "n_tokens").agg(F.count(F.lit(1)).alias("n"), F.sum("xc").alias("sum_xc"))

    run.__name__ = name
    query(f"select (l_partkey % 155)::int as cls_id, t as n_tokens, count(*) as n, sum(trunc(l_quantity)) as sum_xc from (select *, (case when l_linenumber = 7 then 4 when l_linenumber = 6 then 6 else 5 end)::int as t from lineitem) where {test} group by 1, 2")(run)


_rule("label_rows_exact5", "exact5", "t = 5")
_rule("label_rows_min5", "min5", "t >= 5")
_rule("label_rows_nonempty", "nonempty", "t > 0")


@query(f"with {BOXES} select image_id, cls_id, count(*) as n from boxes where cls_id < 0 or cls_id >= 150 group by 1, 2")
def invalid_ids(spark: SparkSession, d: str) -> DataFrame:
    return labels.invalid_ids(tables.boxes(spark, d)).groupBy("image_id", "cls_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {BOXES} select case when cls_id >= 127 then cls_id + 1 else cls_id end as cls_id, count(*) as n from boxes group by 1")
def repair_ids(spark: SparkSession, d: str) -> DataFrame:
    return labels.histogram(labels.repair_ids(tables.boxes(spark, d)))


@query(f"with {BOXES} select * from boxes where bw * bh > 0.85 or bw * bh < 0.04")
def suspicious_boxes(spark: SparkSession, d: str) -> DataFrame:
    return tables.boxes(spark, d).where(labels.suspicious(F.col("bw"), F.col("bh")))


@query(f"with {BOXES}, {IMAGES} select image_id, count(b.cls_id) as n_boxes from images left join boxes b using (image_id) group by 1 having count(b.cls_id) = 0 or bool_or(bw * bh > 0.85 or bw * bh < 0.04)")
def suspicious_images(spark: SparkSession, d: str) -> DataFrame:
    return labels.suspicious_images(tables.images(spark, d), tables.boxes(spark, d))


PIXELS = """pixels as (select image_id, cls_id, xc, yc, bw, bh, width, height, greatest(0, trunc((xc - bw / 2) * width)::int) as x1, greatest(0, trunc((yc - bh / 2) * height)::int) as y1,
    least(width, trunc((xc + bw / 2) * width)::int) as x2, least(height, trunc((yc + bh / 2) * height)::int) as y2 from boxes join images using (image_id))"""


@query(f"with {BOXES}, {IMAGES}, {PIXELS} select image_id, cls_id, x1, y1, x2, y2 from pixels")
def pixel_boxes(spark: SparkSession, d: str) -> DataFrame:
    return geometry.pixel_boxes(with_size(spark, d)).select("image_id", "cls_id", "x1", "y1", "x2", "y2")


@query(f"""with {BOXES}, {IMAGES}, {PIXELS}, m as (select *, trunc((x2 - x1) * 0.04::double)::int as px, trunc((y2 - y1) * 0.04::double)::int as py from pixels),
    c as (select *, greatest(0, x1 - px) as a, least(width, x2 + px) as b, greatest(0, y1 - py) as e, least(height, y2 + py) as f from m)
    select image_id, round(least(greatest((a + b) / 2.0::double / width, 0), 1), 9) as cx, round(least(greatest((b - a) / width, 0.01), 1), 9) as w, round(least(greatest((e + f) / 2.0::double / height, 0), 1), 9) as cy, round(least(greatest((f - e) / height, 0.01), 1), 9) as h from c""")
def normalised_roi(spark: SparkSession, d: str) -> DataFrame:
    df = geometry.normalised_roi(geometry.pixel_boxes(with_size(spark, d)))
    return df.select("image_id", *(F.round(c, 9).alias(c) for c in ("cx", "w", "cy", "h")))


TILE = "floor(image_id % 64 / 8)::bigint as tile_row, image_id % 64 % 8 as tile_col"


@query(f"""with {BOXES}, t as (select *, {TILE} from boxes) select image_id, cls_id, tile_row, tile_col, round(least(greatest(tile_col * 0.125 + xc * 0.125, 0), 1), 9) as nx, round(least(greatest(tile_row * 0.125 + yc * 0.125, 0), 1), 9) as ny,
    round(least(greatest(bw * 0.125, 0.001), 1), 9) as nw, round(least(greatest(bh * 0.125, 0.001), 1), 9) as nh from t""")
def tile_remap(spark: SparkSession, d: str) -> DataFrame:
    df = geometry.tile_remap(tables.boxes(spark, d), F.col("image_id") % 64)
    return df.select("image_id", "cls_id", "tile_row", "tile_col", *(F.round(c, 9).alias(c) for c in ("nx", "ny", "nw", "nh")))


@query("""with n as (select count(*) as n from orders), r as (select o_orderkey as image_id, row_number() over (order by o_orderkey) - 1 as rank from orders),
    s as (select m.range as mosaic, t.range as slot, (('0x' || substr(md5('42:' || m.range || ':' || t.range), 1, 8))::bigint) % n as rank from range(20) m, range(64) t, n)
    select mosaic, slot, image_id from s join r using (rank)""")
def mosaic_plan(spark: SparkSession, d: str) -> DataFrame:
    """Slots of 20 mosaics of 8 x 8, each filled with a random image, with replacement."""
    slots = spark.range(20 * 64).select(F.floor(F.col("id") / 64).alias("mosaic"), (F.col("id") % 64).alias("slot"))
    return pairs.drawn(tables.images(spark, d).select("image_id"), "image_id", slots).select("mosaic", "slot", "image_id")


def _join(name: str, how: str, columns: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return pairs.pair(tables.files(spark, d), tables.table(spark, d, "labels"), "doc_id", how).select(*columns.split())

    run.__name__ = name
    query(f"with {FILES} {sql}")(run)


_join("pairs_inner", "inner", "doc_id stem quality toxic", "select doc_id, stem, quality, toxic from files join labels using (doc_id)")
_join("pairs_left", "left", "doc_id stem quality toxic", "select doc_id, stem, quality, toxic from files left join labels using (doc_id)")
_join("pairs_anti", "left_anti", "doc_id stem", "select doc_id, stem from files anti join labels using (doc_id)")
_join("pairs_semi", "left_semi", "doc_id stem", "select doc_id, stem from files semi join labels using (doc_id)")


@query(f"with {FILES}, l as (select f.class, l.doc_id as label_id from labels l join files f using (doc_id)), a as (select *, row_number() over (partition by class order by doc_id) as rank from files), b as (select *, row_number() over (partition by class order by label_id) as rank from l) select a.class, a.rank::int as rank, doc_id, label_id from a left join b on a.class = b.class and a.rank = b.rank")
def pairs_positional(spark: SparkSession, d: str) -> DataFrame:
    files = tables.files(spark, d)
    found = tables.table(spark, d, "labels").join(files, "doc_id").select("class", F.col("doc_id").alias("label_id"))
    return pairs.positional(files, found, "class", "doc_id", "label_id").select("class", F.col("rank").cast("int").alias("rank"), "doc_id", "label_id")


SPLIT = "split as (select doc_id, class, case when row_number() over (partition by class order by md5('42:' || doc_id), doc_id) <= greatest(1, floor(count(*) over (partition by class) * 0.2::double)) then 'val' else 'train' end as split from files)"


@query(f"with {FILES}, {SPLIT} select doc_id, class, split from split")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return pairs.stratified_split(tables.files(spark, d), "class", "doc_id").select("doc_id", "class", "split")


@query(f"with {FILES}, {SPLIT} select class, count(*) as n, count(*) filter (where split = 'train') as train, count(*) filter (where split = 'val') as val from split group by class")
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    df = pairs.stratified_split(tables.files(spark, d), "class", "doc_id")
    return df.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "val").alias("val"))


@query(f"with {FILES}, {SPLIT}, m as (select doc_id from split where split = 'train' order by md5('7:' || doc_id), doc_id limit 76) select doc_id, case when doc_id in (select doc_id from m) then 'val' else split end as split from split")
def resplit_sample(spark: SparkSession, d: str) -> DataFrame:
    return pairs.resplit(pairs.stratified_split(tables.files(spark, d), "class", "doc_id"), "doc_id").select("doc_id", "split")


@query("select lang || '_' || (doc_id % 700) as name, max_by(doc_id, src * 1000000000 + doc_id) as doc_id, max(src)::int as source_no from (select doc_id, lang, case when doc_id % 3 = 0 then 1 else 0 end as src from documents) group by 1")
def union_last_wins(spark: SparkSession, d: str) -> DataFrame:
    df = tables.table(spark, d, "documents").select(F.concat(F.col("lang"), F.lit("_"), (F.col("doc_id") % 700).cast("string")).alias("name"), "doc_id")
    part = lambda test: df.where(test).groupBy("name").agg(F.max("doc_id").alias("doc_id"))
    return pairs.union_last_wins([part("doc_id % 3 <> 0"), part("doc_id % 3 = 0")], "name")


@query(f"with {FILES} select stem as src, class || '_' || (row_number() over (partition by class order by stem) - 1) as dst from files")
def rename_plan(spark: SparkSession, d: str) -> DataFrame:
    return pairs.rename_plan(tables.files(spark, d), "class", "stem", "%s_%d")


@query(f"with {FILES} select stem as src, class || '_run3_' || lpad((row_number() over (partition by class order by stem))::varchar, 4, '0') as dst from files")
def rename_plan_runid(spark: SparkSession, d: str) -> DataFrame:
    return pairs.rename_plan(tables.files(spark, d), "class", "stem", "%s_run%d_%04d", 1, F.lit(3))


NAMES = "select distinct p_brand || case when p_size % 2 = 0 then '' else 'a' end as class_name from part"


@query(f"select class_name, (row_number() over (order by regexp_extract(lower(class_name), '^([^0-9]*)', 1), try_cast(regexp_extract(class_name, '([0-9]+)', 1) as bigint), class_name) - 1)::int as class_id from ({NAMES})")
def class_map(spark: SparkSession, d: str) -> DataFrame:
    names = tables.table(spark, d, "part").select(F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, "").otherwise("a")).alias("class_name"))
    return labels.class_map(names)


@query(f"with {FILES}, c as (select distinct class as class_name from files), p as (select class_name, row_number() over (order by class_name) as position from c) select stem, min_by(class_name, position) as class_name from files join p on stem = class_name or starts_with(stem, class_name || '_') group by stem")
def prefix_class_match(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    files = tables.files(spark, d)
    names = files.select(F.col("class").alias("class_name")).distinct().withColumn("position", F.row_number().over(W.orderBy("class_name")))
    return labels.prefix_class(files, names)


@query(f"""with {IMAGES}, s as (select *, case when width = 224 and height = 224 then 1 else 212::double / greatest(width, height) end as scale from images), n as (select *, trunc(width * scale)::int as new_w, trunc(height * scale)::int as new_h from s)
    select image_id, new_w, new_h, floor((224 - new_w) / 2)::int as off_x, floor((224 - new_h) / 2)::int as off_y, case when width = 224 and height = 224 then 'none' when scale < 1 then 'area' else 'lanczos' end as method,
    case when width = 224 and height = 224 then 'same' when new_w < 1 or new_h < 1 then 'reject' else 'resize' end as status from n""")
def letterbox_plan_margin(spark: SparkSession, d: str) -> DataFrame:
    return geometry.letterbox_margin(tables.images(spark, d))


@query(f"with {IMAGES}, s as (select *, least(640::double / width, 640::double / height) as scale from images), n as (select image_id, greatest(1, round_even(width * scale, 0)::int) as new_w, greatest(1, round_even(height * scale, 0)::int) as new_h from s) select *, floor((640 - new_w) / 2)::int as off_x, floor((640 - new_h) / 2)::int as off_y from n")
def letterbox_plan_fit(spark: SparkSession, d: str) -> DataFrame:
    return geometry.letterbox_fit(tables.images(spark, d))


@query(f"with {IMAGES} select * from images where width >= 100 and height >= 100")
def min_size_filter(spark: SparkSession, d: str) -> DataFrame:
    return tables.images(spark, d).where("width >= 100 and height >= 100")


@query(f"with {IMAGES} select image_id % 10 as folder, count(*) as total, count(*) filter (where width = 224 and height = 224) as skipped, count(*) filter (where width < 3 or height < 3) as errors from images group by rollup (image_id % 10)")
def resize_stats(spark: SparkSession, d: str) -> DataFrame:
    df = tables.images(spark, d).withColumn("folder", F.col("image_id") % 10)
    return df.rollup("folder").agg(F.count(F.lit(1)).alias("total"), F.count_if((F.col("width") == 224) & (F.col("height") == 224)).alias("skipped"), F.count_if((F.col("width") < 3) | (F.col("height") < 3)).alias("errors"))


@query(f"""with {IMAGES}, s as (select *, width // 10 as col_w, height // 25 * 4 as step from images where height >= 25), c as (select *, unnest(range(10)) as col from s), r as (select *, unnest(range(0, height, step)) as y from c)
    select image_id, col::int as col, col * col_w as x, y, col_w, least(step, height - y) as seg_h from r where least(step, height - y) > 50""")
def strip_segments(spark: SparkSession, d: str) -> DataFrame:
    return geometry.strip_segments(tables.images(spark, d))


@query(f"""with {IMAGES}, a as (select *, unnest(range(case when width <= 640 then 1 else ceil((width - 640) / 480)::bigint + 1 end)) as i from images), b as (select *, unnest(range(case when height <= 640 then 1 else ceil((height - 640) / 480)::bigint + 1 end)) as j from a)
    select image_id, greatest(0, least(i * 480, width - 640)) as x, greatest(0, least(j * 480, height - 640)) as y, least(640, width) as tile_w, least(640, height) as tile_h from b""")
def sliding_tiles(spark: SparkSession, d: str) -> DataFrame:
    return geometry.sliding_tiles(tables.images(spark, d))


@query(f"with {BOXES}, s as (select image_id, sum(round(bw * 100))::bigint as h, sum(round(bh * 100))::bigint as v from boxes group by 1) select image_id, case when h > 500 and h > 1.5 * v then 'rows' when v > 500 and v > 1.5 * h then 'columns' else 'rows' end as layout from s")
def layout_decision(spark: SparkSession, d: str) -> DataFrame:
    s = tables.boxes(spark, d).groupBy("image_id").agg(F.sum(F.round(F.col("bw") * 100).cast("long")).alias("h"), F.sum(F.round(F.col("bh") * 100).cast("long")).alias("v"))
    return s.select("image_id", geometry.layout(F.col("h"), F.col("v")).alias("layout"))


CODES = "'A' || p_size || case when p_partkey % 3 = 0 then 'b' else '' end || case when p_partkey % 4 = 0 then ' Zz' || (p_partkey % 5) else '' end"
ENTRIES = f"e as (select p_partkey as doc, p_name as translit, p_type as translation, {CODES} as codes from part)"


def dictionary_text(spark: SparkSession, d: str) -> DataFrame:
    """Lines of one document per part: an entry, wrapped before its codes for every third part, and noise."""
    p = tables.table(spark, d, "part")
    codes = F.expr(CODES)
    head = F.concat(F.lit("["), "p_name", F.lit("] "), "p_type")
    tail = F.concat(F.lit("{"), codes, F.lit("}"))
    lines = F.when(F.col("p_partkey") % 3 == 1, F.array(F.lit("12"), head, F.lit("no brackets here"), tail)).otherwise(F.array(F.concat_ws(" ", head, tail), F.lit(" "), F.lit("Dictionary of Middle Egyptian")))
    return p.select(F.col("p_partkey").alias("doc"), F.posexplode(lines).alias("pos", "line"))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    known = spark.range(1, 41).select(F.concat(F.lit("A"), F.col("id").cast("string")).alias("code"))
    return lexicon.routed(lexicon.entries(dictionary_text(spark, d)), known)


@query("select k as kind, count(*) as n from (select unnest(case when p_partkey % 3 = 1 then ['number', 'text', 'noise', 'text'] else ['text', 'empty', 'header'] end) as k from part) group by 1")
def dictionary_lines(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.classify_lines(dictionary_text(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {ENTRIES} select doc, translit, translation, codes from e")
def dictionary_entries(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.entries(dictionary_text(spark, d)).select("doc", "translit", "translation", "codes")


KNOWN = "(regexp_matches(codes, '^A[0-9]+b?$') and regexp_extract(codes, '[0-9]+')::int between 1 and 40)"
UNKNOWN = "array_to_string(list_filter(string_split(codes, ' '), lambda c: starts_with(c, 'Zz') or regexp_extract(c, '[0-9]+')::int > 40), ' ')"
SEQ = "array_to_string(list_transform(string_split(codes, ' '), lambda c: case when ends_with(c, 'b') and regexp_extract(c, '[0-9]+')::int <= 40 then c[:-2] else c end), ' ')"


@query(f"with {ENTRIES} select doc, translit, {SEQ} as gardiner_seq, case when ends_with(codes, 'b') then codes else '' end as gardiner_seq_orig from e where {KNOWN}")
def dictionary_clean(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).where("clean").select("doc", "translit", "gardiner_seq", "gardiner_seq_orig")


@query(f"with {ENTRIES} select doc, translit, {SEQ} as gardiner_seq, codes as gardiner_seq_orig, {UNKNOWN} as unknown_codes from e where not {KNOWN}")
def dictionary_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).where("not clean").select("doc", "translit", "gardiner_seq", "gardiner_seq_orig", "unknown_codes")


@query(f"with {ENTRIES}, u as (select unnest(string_split({UNKNOWN}, ' ')) as code from e where not {KNOWN}) select code, count(*) as n from u group by 1 order by n desc, code limit 30")
def unknown_codes_top30(spark: SparkSession, d: str) -> DataFrame:
    u = _entries(spark, d).where("not clean").select(F.explode(F.split("unknown_codes", " ")).alias("code"))
    return audit.top(u.groupBy("code").agg(F.count(F.lit(1)).alias("n")), "n", "code", 30)


TOTALS = f"""with {ENTRIES}, l as (select count(*) as n_lines, count(*) filter (where k = 'noise') as dropped from (select unnest(case when p_partkey % 3 = 1 then ['number', 'text', 'noise', 'text'] else ['text', 'empty', 'header'] end) as k from part)),
    j as (select sum(length(translit) + length(translation) + length(codes) + 6)::bigint as joined_chars from e), n as (select unnest(string_split(codes, ' ')) as c from e), u as (select unnest(string_split({UNKNOWN}, ' ')) as code from e where not {KNOWN})
    select *, (select count(*) from e) as candidates, (select count(*) from e where {KNOWN}) as clean, (select count(*) from e where not {KNOWN}) as quarantined,
    (select count(*) from n where ends_with(c, 'b') and regexp_extract(c, '[0-9]+')::int <= 40) as normalised, (select count(distinct code) from u) as unknown_codes from l, j"""


@query(TOTALS)
def parse_totals(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.totals(dictionary_text(spark, d), _entries(spark, d))


@query("select p_partkey as doc, 2 as pos, 'no brackets here' as line, 'noise' as kind from part where p_partkey % 3 = 1 order by 1 limit 15")
def first_dropped_lines(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.first_lines(dictionary_text(spark, d), "noise", 15)


@query(f"with {SCORES} select cls::int as cls, max(score) as best from scores group by 1 order by best desc, cls limit 10")
def score_topk_classes(spark: SparkSession, d: str) -> DataFrame:
    return audit.top(scores.class_maxima(tables.scores(spark, d)), "best", "cls", 10)


@query(f"with {SCORES} select min(score) as low, max(score) as high, count(score) as n, round(avg(score::double), 9) as mean, count(*) filter (where score > 0.25) as over_25, count(*) filter (where score > 0.5) as over_50, count(*) filter (where score > 0.8::double) as over_80 from scores")
def score_distribution(spark: SparkSession, d: str) -> DataFrame:
    return scores.distribution(tables.scores(spark, d))


def _truth(spark: SparkSession, d: str) -> DataFrame:
    first = F.slice("embedding", 1, 10)
    return tables.table(spark, d, "embeddings").select(F.col("label").cast("long").alias("truth"), (F.array_position(first, F.array_max(first)) - 1).alias("pred"))


@query(f"with {TRUTH} select row_label::bigint as row_label, col_label::bigint as col_label, count(*) as n from truth group by 1, 2")
def confusion_long(spark: SparkSession, d: str) -> DataFrame:
    return scores.confusion(_truth(spark, d), "truth", "pred")


GRID = "g as (select a.range as row_label, b.range as col_label, count(t.row_label) as n from range({n}) a cross join range({n}) b left join truth t on t.row_label = a.range and t.col_label = b.range group by 1, 2)"


@query(f"with {TRUTH}, {GRID.format(n=12)} select row_label, col_label, n, case when sum(n) over (partition by row_label) > 0 then n / sum(n) over (partition by row_label) else 0 end as share from g")
def confusion_normalised(spark: SparkSession, d: str) -> DataFrame:
    return scores.normalised(scores.confusion(_truth(spark, d), "truth", "pred"), 12)


@query(f"with {TRUTH}, s as (select row_label::bigint as row_label, col_label::bigint as col_label, count(*) as n from truth where row_label in (1, 3, 5) and col_label in (1, 3, 5) group by 1, 2) select *, n / sum(n) over (partition by row_label) as share from s")
def confusion_subset(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    some = scores.confusion(_truth(spark, d), "truth", "pred").where("row_label in (1, 3, 5) and col_label in (1, 3, 5)")
    return some.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("row_label")))


@query(f"with {SCORES}, m as (select cls::int as cls, max(score) as best from scores group by 1), w as (select *, 'worst' as side from m order by best, cls limit 20), b as (select *, 'best' as side from m order by best desc, cls limit 10) select * from w union all select * from b")
def worst_best_classes(spark: SparkSession, d: str) -> DataFrame:
    return audit.worst_best(scores.class_maxima(tables.scores(spark, d)), "best", "cls")


@query(f"with {SCORES}, m as (select cls::int as cls, max(score) as best from scores group by 1) select * from m where best > 0 order by best, cls desc limit 10")
def bottom_classes(spark: SparkSession, d: str) -> DataFrame:
    return audit.bottom(scores.class_maxima(tables.scores(spark, d)), "best", "cls", 10)


@query(f"with {DETECTIONS} select name, case when conf >= 0.8::double then 'sure' when conf >= 0.5 then 'doubtful' else 'poor' end as tier, count(*) as n from detections group by 1, 2")
def confidence_tiers(spark: SparkSession, d: str) -> DataFrame:
    return tables.detections(spark, d).groupBy("name", tier(F.col("conf")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {DETECTIONS} select event_id, round_even(conf * 1.5::double, 6) as rescaled, round_even(conf * 1.5::double, 6) <> conf as changed, repeat('█', floor(conf * 20)::int) as bar from detections where conf >= 0.25")
def confidence_bars(spark: SparkSession, d: str) -> DataFrame:
    df = tables.detections(spark, d).where(F.col("conf") >= 0.25)
    return df.select("event_id", *rescaled(F.col("conf")), bar(F.col("conf")).alias("bar"))


DEVICE = "c_mktsegment || case c_custkey % 4 when 0 then ' A100-SXM4-40GB' when 1 then ' NVIDIA L4' when 2 then ' Tesla T4' else ' CPU' end"


@query(f"with n as (select c_custkey, {DEVICE} as name from customer) select c_custkey, case when name like '%A100%' then 128 when name like '%L4%' then 32 when name like '%T4%' then 16 else 8 end as batch from n")
def device_batches(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "customer").select("c_custkey", batch_for_device(F.expr(DEVICE)).alias("batch"))


@query("with p as (select vec_id, unnest(embedding) as value, generate_subscripts(embedding, 1) - 1 as pos from embeddings), t as (select vec_id, round(value * 1000)::bigint as value, pos // 8 as r, pos % 8 as c from p), b as (select vec_id, value from t where r in (0, 7) union all select vec_id, value from t where c in (0, 7)) select vec_id, trunc(median(value))::int as median from b group by 1")
def border_median(spark: SparkSession, d: str) -> DataFrame:
    p = tables.table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return scores.border_median(p.select("vec_id", "pos", F.round(F.col("v").cast("double") * 1000).cast("long").alias("value")), "vec_id", 8)


CONF = "(image_id * 31 + cls_id * 17 + x1) % 101 / 100.0::double"
INTER = "greatest(least(b.x2, k.x2) - greatest(b.x1, k.x1), 0) * greatest(least(b.y2, k.y2) - greatest(b.y1, k.y1), 0)"
AREA = "greatest({0}.x2 - {0}.x1, 0) * greatest({0}.y2 - {0}.y1, 0)"
#: What is left of the boxes `l` once its first is kept.
REST = f"list_filter(l[2:], lambda b: {INTER} <= 0.3::double * greatest({AREA.format('b')} + {AREA.format('k')} - {INTER}, 1e-12))".replace("k.", "l[1].")


@query(f"""with recursive {BOXES}, {IMAGES}, {PIXELS}, g as (select image_id, cls_id % 3 as cls_id, list({{'o': -({CONF}), 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'conf': {CONF}}} order by -({CONF}), x1, y1, x2, y2) as l from pixels where {CONF} >= 0.25 group by all),
    s as (select image_id, cls_id, l[1] as kept, {REST} as rest from g union all select image_id, cls_id, l[1], {REST} from (select image_id, cls_id, rest as l from s where len(rest) > 0))
    select image_id, cls_id, kept.conf as conf, kept.x1 as x1, kept.y1 as y1, kept.x2 as x2, kept.y2 as y2 from s""")
def nms(spark: SparkSession, d: str) -> DataFrame:
    return scores.nms(confident_boxes(spark, d))


def confident_boxes(spark: SparkSession, d: str, *hint: str) -> DataFrame:
    """Pixel boxes of three classes with a confidence; a hint says how boxes are joined with their images."""
    sizes = tables.images(spark, d)
    df = geometry.pixel_boxes(tables.boxes(spark, d).join(sizes.hint(*hint) if hint else sizes, "image_id")).withColumn("conf", (F.col("image_id") * 31 + F.col("cls_id") * 17 + F.col("x1")) % 101 / 100.0)
    return df.select("image_id", (F.col("cls_id") % 3).alias("cls_id"), "conf", "x1", "y1", "x2", "y2")


from tesselon.plans import dataset, detection  # noqa: E402, F401  register their queries
