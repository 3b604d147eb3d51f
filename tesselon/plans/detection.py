"""Further queries: renames in place, matched boxes, average precision, merged slices, corrected sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.operators import geometry, longtext, matching, renames, trie
from tesselon.plans.catalog import ENTRIES, IMAGES, confident_boxes, dictionary_text
from tesselon.plans.registry import ORACLE_SQL, query
from tesselon.sources import tables

# --- renames in place ----------------------------------------------------------------------------

#: Blocks of 32 files: free names, a chain of 8, a cycle of 8, two cycles of 3 and a swap.
RENAMES = """select 'f' || doc_id as src, case when doc_id % 32 < 8 or doc_id % 32 = 15 then 'g' || doc_id when doc_id % 32 < 15 then 'f' || (doc_id + 1) when doc_id % 32 < 24 then 'f' || (doc_id - doc_id % 8 + (doc_id + 1) % 8)
    when doc_id % 8 < 6 then 'f' || (doc_id - doc_id % 8 % 3 + (doc_id % 8 % 3 + 1) % 3) when doc_id % 8 = 6 then 'f' || (doc_id + 1) else 'f' || (doc_id - 1) end as dst from documents"""
MOVE_ORDER = f"""with recursive p as ({RENAMES}), m as (select src, dst, dst in (select src from p) as blocked, src in (select dst from p) as followed from p where src <> dst),
    chain as (select src, dst, followed, 0::bigint as place, blocked from m where not blocked union all select m.src, m.dst, m.followed, chain.place + 1, m.blocked from m join chain on m.dst = chain.src),
    r as (select src, dst from m where src not in (select src from chain)), reach as (select src, dst as n from r union select reach.src, r.dst from reach join r on reach.n = r.src),
    low as (select src, min(n) as low from reach group by src), c as (select src, dst, low from r join low using (src)),
    ring as (select src, dst, low, 0::bigint as place from c where dst = low union all select c.src, c.dst, c.low, ring.place + 1 from c join ring on c.dst = ring.src and ring.src <> ring.low),
    o as (select src, dst, case when blocked or followed then 'chain' else 'free' end as kind, place, place % 2 = 1 as aside from chain union all select src, dst, 'cycle', place, place % 2 = 1 or src = low from ring
        union all select src, dst, 'same', 0, false from p where src = dst)"""


def _renames(spark: SparkSession, d: str) -> DataFrame:
    tables.table(spark, d, "documents").createOrReplaceTempView("rename_documents")
    return renames.move_order(spark.sql(RENAMES.replace("from documents", "from rename_documents")))


@query(f"{MOVE_ORDER} select src, dst, kind, place, aside from o")
def rename_order(spark: SparkSession, d: str) -> DataFrame:
    return _renames(spark, d)


@query(f"{MOVE_ORDER} select 2 as pass, src, dst from o where kind <> 'same' and not aside union all select 1, src, '.moving-' || md5(src) from o where aside union all select 3, '.moving-' || md5(src), dst from o where aside")
def rename_passes(spark: SparkSession, d: str) -> DataFrame:
    return renames.passes(_renames(spark, d))


# --- boxes against boxes -------------------------------------------------------------------------

TRUTH = f"""{IMAGES}, tb as (select l_orderkey as image_id, ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 1000000 + l_suppkey * 100 + l_quantity::bigint as truth_id, l_partkey % 5 as cls_id, l_quantity / 51 as xc, (l_suppkey % 97) / 97 as yc, l_discount * 10 as bw, l_tax * 12.5 as bh from lineitem),
    truth as (select image_id, truth_id, cls_id, greatest(0, trunc((xc - bw / 2) * width)::int) as x1, greatest(0, trunc((yc - bh / 2) * height)::int) as y1, least(width, trunc((xc + bw / 2) * width)::int) as x2, least(height, trunc((yc + bh / 2) * height)::int) as y2 from tb join images using (image_id))"""
FOUND = f"""{TRUTH}, found as (select image_id, truth_id as det_id, case when truth_id % 7 = 0 then (cls_id + 1) % 5 else cls_id end as cls_id, truth_id % 1009 * 37 % 101 / 100::double as conf, x1 + truth_id % 41 - 20 as x1, y1 + truth_id % 23 - 11 as y1, x2 + truth_id % 41 - 20 as x2, y2 + truth_id % 23 - 11 as y2 from truth where truth_id % 11 <> 0
    union all select image_id, -truth_id, cls_id, truth_id % 1009 * 53 % 97 / 100::double, x1 + 9, y1 - 5, x2 + 3, y2 from truth where truth_id % 9 = 0)"""
BOTH = "greatest(least(d.x2, t.x2) - greatest(d.x1, t.x1), 0) * greatest(least(d.y2, t.y2) - greatest(d.y1, t.y1), 0)"


def _matched_sql(keys: str, test: str, conf: float) -> str:
    """Matches of boxes: each image's candidates as a list, whose first goes with all that share a box with it."""
    rest = "list_filter(l[2:], lambda p: p.d <> l[1].d and p.t <> l[1].t)"
    return f"""{FOUND}, c as (select {keys}, det_id as d, truth_id as t, b / ((dx * dy + tx * ty) - b) as iou from (select {keys}, det_id, truth_id, {BOTH} as b, d.x2 - d.x1 as dx, d.y2 - d.y1 as dy, t.x2 - t.x1 as tx, t.y2 - t.y1 as ty from found d join truth t using ({keys}) where conf >= {conf}) where b > 0),
        g as (select {keys}, list({{'d': d, 't': t, 'iou': iou}} order by -iou, d, t) as l from c where iou {test} group by all),
        m as (select {keys}, l[1] as kept, {rest} as rest from g union all select {keys}, l[1], {rest} from (select {keys}, rest as l from m where len(rest) > 0)),
        pairs as (select kept.d as det_id, kept.t as truth_id, kept.iou as iou from m)"""


def _truth(spark: SparkSession, d: str) -> DataFrame:
    """True boxes, merged with their images: what is taken by image afterwards is not shuffled again. Columns travel as they are, which packs better."""
    raw = tables.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    b = raw.join(tables.images(spark, d).hint("merge"), F.col("l_orderkey") == F.col("image_id")).select(
        "image_id", F.expr("((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 1000000 + l_suppkey * 100 + cast(l_quantity as bigint)").alias("truth_id"), (F.col("l_partkey") % 5).alias("cls_id"), (F.col("l_quantity") / 51).alias("xc"),
        ((F.col("l_suppkey") % 97) / 97).alias("yc"), (F.col("l_discount") * 10).alias("bw"), (F.col("l_tax") * 12.5).alias("bh"), "width", "height",
    )
    return geometry.pixel_boxes(b).select("image_id", "truth_id", "cls_id", *matching.CORNERS)


def _found(truth: DataFrame) -> DataFrame:
    """Detections: true boxes moved a little, some of a wrong class, some lost, some found twice."""
    k = F.col("truth_id")
    box = lambda det, cls, conf, x1, y1, x2, y2: F.struct(det.alias("det_id"), cls.alias("cls_id"), conf.alias("conf"), *(c.alias(n) for c, n in zip((x1, y1, x2, y2), matching.CORNERS, strict=True)))
    own, (x1, y1, x2, y2) = F.col("cls_id"), (F.col(c).cast("long") for c in matching.CORNERS)
    one = box(k, F.when(k % 7 == 0, (own + 1) % 5).otherwise(own), k % 1009 * 37 % 101 / 100.0, x1 + k % 41 - 20, y1 + k % 23 - 11, x2 + k % 41 - 20, y2 + k % 23 - 11)
    two = box(-k, own, k % 1009 * 53 % 97 / 100.0, x1 + 9, y1 - 5, x2 + 3, y2)
    both = F.filter(F.array(F.when(k % 11 != 0, one), F.when(k % 9 == 0, two)), lambda b: b.isNotNull())
    return truth.select("image_id", F.inline(both))


@query(f"""with recursive {_matched_sql("image_id", "> 0.45::double", 0.25)}, s as (select * from found where conf >= 0.25)
    select coalesce(s.cls_id, 5)::bigint as row_label, coalesce(t.cls_id, 5)::bigint as col_label, count(*) as n from (select * from s left join pairs using (det_id)) s full join truth t using (truth_id) group by 1, 2""")
def confusion_from_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Found against true classes, with a background row and column."""
    truth = _truth(spark, d)
    return matching.confusion_of_boxes(_found(truth), truth, 5)


@query(f"""with recursive {_matched_sql("image_id, cls_id", ">= 0.5::double", 0)}, n as (select cls_id, count(*) as n_truth from truth group by 1), f as (select cls_id, count(*) as n_found from found group by 1),
    r as (select *, row_number() over (partition by cls_id order by conf desc, det_id) as place from found), v as (select range * 5 as level from range(10, 20)),
    h as (select r.cls_id, level, n_truth, place, row_number() over (partition by r.cls_id, level order by place) as k from r join pairs using (det_id) join n using (cls_id) join v on iou >= level / 100::double),
    p as (select *, k / place as p, k / n_truth as r, 2 * k / (place + n_truth) as f1 from h),
    e as (select cls_id, level, j.range as j, coalesce(max(p.p), 0) as best from n cross join v cross join range(101) j left join p using (cls_id, level) where p.k is null or p.k * 100 // p.n_truth >= j.range group by all),
    a as (select cls_id, level, sum(best) / 101 as ap from e group by all), u as (select cls_id, arg_max(p, {{'f1': f1, 'o': -place}}) as p, arg_max(r, {{'f1': f1, 'o': -place}}) as r from p where level = 50 group by 1)
    select cls_id, n_truth, coalesce(n_found, 0) as n_found, round(coalesce(u.p, 0), 9) as precision, round(coalesce(u.r, 0), 9) as recall, round(coalesce(max(ap) filter (level = 50), 0), 9) as ap50, round(coalesce(sum(ap), 0) / 10, 9) as ap50_95
    from n left join f using (cls_id) left join u using (cls_id) left join a using (cls_id) group by all""")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and average precision of each class."""
    truth = _truth(spark, d)
    return matching.average_precision(_found(truth), truth)


@query(f"select distinct * from ({ORACLE_SQL['nms']})")
def nms_crowded(spark: SparkSession, d: str) -> DataFrame:
    """Suppression by overlapping neighbours only, for images of any number of boxes."""
    return matching.suppressed(confident_boxes(spark, d, "merge"))


#: Tiles 640 wide with steps of 480, and what each has of the boxes that are 8 pixels or more on a side.
PIECES = f"""{TRUTH}, a as (select *, unnest(range(case when width <= 640 then 1 else ceil((width - 640) / 480)::bigint + 1 end)) as i from images), t as (select *, unnest(range(case when height <= 640 then 1 else ceil((height - 640) / 480)::bigint + 1 end)) as j from a),
    tiles as (select image_id, greatest(0, least(i * 480, width - 640)) as tx, greatest(0, least(j * 480, height - 640)) as ty, least(640, width) as tw, least(640, height) as th from t),
    w as (select image_id, cls_id, truth_id % 1009 * 37 % 101 / 100::double as conf, concat_ws(':', truth_id, tx, ty) as piece_id, tx, ty, tx + tw as tx2, ty + th as ty2, greatest(x1, tx) as x1, greatest(y1, ty) as y1, least(x2, tx + tw) as x2, least(y2, ty + th) as y2
        from truth join tiles using (image_id) where x2 - x1 >= 8 and y2 - y1 >= 8 and least(x2, tx + tw) > greatest(x1, tx) and least(y2, ty + th) > greatest(y1, ty))"""


@query(f"""with recursive {PIECES}, n as (select a.piece_id as a, b.piece_id as b, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) as common,
        (least(a.x2, b.tx2) - greatest(a.x1, b.tx)) * (least(a.y2, b.ty2) - greatest(a.y1, b.ty)) as sa, (least(b.x2, a.tx2) - greatest(b.x1, a.tx)) * (least(b.y2, a.ty2) - greatest(b.y1, a.ty)) as sb
        from w a join w b using (image_id, cls_id) where a.piece_id <> b.piece_id and (a.tx <> b.tx or a.ty <> b.ty)),
    l as (select a, b from n where common > 0 and common >= 0.5::double * (sa + sb - common)), r as (select piece_id as a, piece_id as b from w union select r.a, l.b from r join l on r.b = l.a),
    o as (select a as piece_id, min(b) as object from r group by 1)
    select image_id, cls_id, max(conf) as conf, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2, count(*) as n_pieces from w join o using (piece_id) group by image_id, cls_id, object""")
def merged_slices(spark: SparkSession, d: str) -> DataFrame:
    """Boxes as overlapping tiles show them, put together again."""
    boxes = _truth(spark, d).where("x2 - x1 >= 8 and y2 - y1 >= 8").withColumn("conf", F.col("truth_id") % 1009 * 37 % 101 / 100.0)
    pieces = matching.cut_by_tiles(boxes, geometry.sliding_tiles(tables.images(spark, d)))
    return matching.merged_slices(pieces.withColumn("piece_id", F.concat_ws(":", *(F.col(c).cast("string") for c in ("truth_id", "tile_x", "tile_y")))).drop("truth_id"))


# --- corrected sequences -------------------------------------------------------------------------

#: Sequences of four codes from part keys; customers' sequences are such with a code missing, mistaken or superfluous.
LEXICON = "select array['A' || p_partkey % 9, 'B' || p_partkey * 7 % 11, 'C' || p_partkey * 3 % 13, 'D' || p_size % 5] as seq from part"
SEEN = """select case c_custkey % 6 when 0 then array[a, c, d] when 1 then array[a, 'B' || (n + 1) % 11, c, d] when 2 then array[a, b, 'X1', c, d] when 3 then array[b, c] when 4 then array['Y2', 'A0', b, c, d] else array[a, b, c, d] end as seq
    from (select c_custkey, c_custkey * 7 % 11 as n, 'A' || c_custkey % 9 as a, 'B' || c_custkey * 7 % 11 as b, 'C' || c_custkey * 3 % 13 as c, 'D' || c_custkey % 5 as d from customer)"""
MISTAKES = [(f"B{(i + 1) % 11}", f"B{i}", 300) for i in range(11)] + [(f"D{i}", f"D{(i + 2) % 5}", 450) for i in range(5)]


@query(f"""with recursive lex as (select array_to_string(seq, ' ') as w, seq, count(*) as n from ({LEXICON.replace("array[", "[")}) group by all), seen as (select distinct seq from ({SEEN.replace("array[", "[")})),
    e as (select distinct array_to_string(seq[:range], ' ') as parent, array_to_string(seq[:range + 1], ' ') as node, seq[range + 1] as code from lex, range(4) where range < len(seq)),
    moves as (select parent, node, code, false as stay from e union all select distinct node, node, null, true from e union all select '', '', null, true), mistakes(s, m, c) as (values {", ".join(f"('{a}', '{b}', {c})" for a, b, c in MISTAKES)}),
    st as (select seq, 0 as i, '' as node, 0 as cost from seen union select * from (select seq, i + took as i, m.node as node, cost + case when m.stay or took = 0 then 1000 when m.code = seq[i + 1] then 0 else coalesce(x.c, 1000) end as cost
        from st join moves m on m.parent = st.node cross join (select unnest([0, 1]) as took) left join mistakes x on x.s = seq[i + 1] and x.m = m.code where not (m.stay and took = 0) and i + took <= len(seq)) where cost <= 1500),
    f as (select st.seq as seq, arg_min(w, {{'c': cost, 'o': -n, 'w': replace(w, ' ', chr(31))}}) as w, min(cost)::bigint as cost from st join lex on st.node = lex.w where i = len(st.seq) group by st.seq)
    select array_to_string(seen.seq, ' ') as seen, w as fixed, cost from seen left join f using (seq)""")
def corrected_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Customers' sequences by the lexicon of parts."""
    for t in ("part", "customer"):
        tables.table(spark, d, t).createOrReplaceTempView(f"trie_{t}")
    lexicon = trie.prefix_table(spark.sql(LEXICON.replace("array[", "array(").replace("] as seq", ") as seq").replace("from part", "from trie_part")))
    seen = spark.sql(SEEN.replace("array[", "array(").replace("]", ")").replace("from customer", "from trie_customer"))
    found = trie.corrected(seen, lexicon, spark.createDataFrame(MISTAKES, "seen string, meant string, cost long"))
    return found.select(F.array_join("seq", " ").alias("seen"), F.array_join("fixed", " ").alias("fixed"), "cost")


# --- one long document ---------------------------------------------------------------------------


@query(f"with {ENTRIES} select row_number() over (order by doc) - 1 as n, translit, translation, codes, '[' || translit || '] ' || translation || ' {{' || codes || '}}' as raw from e")
def long_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary of all parts as a single document."""
    lines = dictionary_text(spark, d).select(F.lit(1).alias("book"), F.struct("doc", "pos").alias("place"), "line")
    return longtext.entries(lines, "book", "place").drop("book")
