"""The same results in plain SQL, for DuckDB over the same tables.

The SQL follows the definitions directly (pairs, recursion, one scan per threshold) and shares
nothing with the Spark plans.
"""
from __future__ import annotations

from tubelens import config as C

BASE = """
fx_base as (
  select user_id as v, event_id as e, value,
         cast(20+(user_id*17+(event_id%3)*53)%120 as double) as bx,
         cast(15+(user_id*29+(event_id%3)*31)%80  as double) as by_,
         15+(user_id%4)*5 as w, 10+(user_id%3)*4 as h
  from events),
det as (
  select e as det_id, v as volume_id, cast(floor(e/3) as bigint)%12 as slice_z,
         bx+e%7-3 as x1, by_+e%5-2 as y1, bx+e%7-3+w+e%4-1 as x2, by_+e%5-2+h+e%3-1 as y2,
         cast(least(value/cast(500 as double),cast(0.999999 as double)) as double) as score
  from fx_base),
vols as (select distinct user_id as volume_id from events),
fx_gtc as (
  select v, k,
         case when k=0 then 20+(v*17)%120+(case v%5 when 1 then 7 when 2 then 10 else 0 end)
              else 20+(v*17+53)%120 end as c0,
         case when k=0 then 15+(v*29)%80+(case when v%7=0 then 40 else 0 end)
              else 15+(v*29+31)%80 end as r0,
         15+(v%4)*5 as w, 10+(v%3)*4 as h
  from (select volume_id as v from vols) a cross join (select 0 as k union all select 1 as k) b
  where k=0 or v%4=0),
gt_slices as (
  select v as volume_id, z as slice_z, r0, c0, r0+h-1 as r1, c0+w-1 as c1, cast(k as bigint) as component_id
  from fx_gtc cross join range(1, 11) t(z)),
gt2 as (select volume_id, slice_z, component_id, cast(c0 as double) x1, cast(r0 as double) y1,
               cast(c1+1 as double) x2, cast(r1+1 as double) y2 from gt_slices),
gt_boxes as (
  select v as public_id, cast(k+1 as bigint) as label_id, cast(5.5 as double) as coordX,
         cast(2*c0+w-1 as double) as coordY, cast(2*r0+h-1 as double) as coordZ,
         cast(9 as double) as x_length, cast(2*(w-1) as double) as y_length, cast(2*(h-1) as double) as z_length
  from fx_gtc
  union all
  select cast(1000000+r_regionkey as bigint), cast(1 as bigint), cast(10 as double), cast(10 as double), cast(10 as double),
         cast(4 as double), cast(4 as double), cast(4 as double) from region),
pred as (
  select e as pred_id, v as public_id, cast(5.5+e%5-2 as double) as coordX,
         2*bx+w-1+(e%11-5)*2 as coordY, 2*by_+h-1+e%7-3 as coordZ,
         cast(9-e%2 as double) as x_length, cast(2*(w-1) as double) as y_length, cast(2*(h-1)+e%3 as double) as z_length,
         cast(least(value/cast(500 as double),cast(0.999999 as double)) as double) as probability
  from fx_base),
meta as (select volume_id, 400 nx0, 640 nx1, 12 nx2, 200 n0, 320 n1, 12 n2 from vols),
frames as (select volume_id, 150+volume_id%9 n0, 320+volume_id%22 n1, 12+volume_id%3 n2 from vols),
manifest as (
  select volume_id, case when volume_id%10<=6 then 'train' when volume_id%10<=8 then 'val' else 'test' end split,
         case when volume_id%10<=6 then volume_id%5 else -1 end fold, case when volume_id%2=0 then 'B' else 'M' end label
  from vols),
dirty as (
  select det_id, volume_id, slice_z, case when det_id%10=3 then x2 else x1 end x1, y1,
         case when det_id%10=3 then x1 else x2 end x2, case when det_id%10=4 then y1 else y2 end y2,
         case when det_id%10=5 then score+1 when det_id%10=6 then null else score end score from det),
members as (select *, volume_id*3+det_id%3 as tube_id from det),
record as (
  select public_id,
         concat_ws(':', d, cast(public_id as varchar), cast(pred_id as varchar)) candidate_id, d detector_of_origin,
         case when public_id%10<=6 then 'train' when public_id%10<=8 then 'val' else 'test' end split,
         case when public_id%10<=6 then public_id%5 else -1 end fold,
         coordX, coordY, coordZ, x_length, y_length, z_length,
         probability score_max, probability*cast(0.5 as double) score_mean, probability*cast(0.1 as double) score_std,
         probability*cast(0.25 as double) score_min,
         1+pred_id%7 slice_count, 1+pred_id%9 z_span, cast(1+pred_id%7 as double)/(1+pred_id%9) fill_ratio,
         cast(pred_id%13 as double)/100 centroid_jitter, cast(pred_id%17 as double)/50 area_cv,
         cast(0 as bigint) rank, cast(0 as double) rank_norm,
         case when pred_id%4=0 then 'pos' when pred_id%4=1 then 'ignore' else 'neg' end label,
         cast(pred_id%10 as double)/10 iou_gt, coordZ/2 cen_d0, coordY/2 cen_d1, coordX cen_d2,
         cast(pred_id%11 as double) ext_d0, cast(pred_id%6 as double) ext_d1, cast(pred_id%5 as double) ext_d2,
         case when public_id%3=0 then 'old' else 'new' end preprocess_hash, pred_id cand_seq
  from (select *, case when public_id%10<=6 then concat('fold', public_id%5) else concat('full_seed', pred_id%3) end d from pred)),
voxels as (
  select distinct volume_id, r d0, c d1, slice_z d2
  from (select *, unnest(range(r0, r1+1)) r from gt_slices) a, lateral (select unnest(range(a.c0, a.c1+1)) c)),
gt_iso as (
  select volume_id, min(r0) min_d0, min(c0) min_d1, min(slice_z) min_d2, max(r1) max_d0, max(c1) max_d1, max(slice_z) max_d2
  from gt_slices group by 1),
epoch_log as (
  select v%4 run, e%12 epoch, floor(avg(value))/cast(1000 as double) cpm, floor(max(value))%7/cast(10 as double) ceiling
  from fx_base group by 1, 2),
slice_stats as (select volume_id, slice_z, count(*) n, avg(score) mean, sum(score*score) sumsq, max(score) top from det group by 1, 2),
anchors as (
  select v image, e%2 level, e anchor_id, cast((e*7)%160 as double) x1, cast((e*5)%110 as double) y1,
         cast((e*7)%160+16+16*(e%2) as double) x2, cast((e*5)%110+12+12*(e%2) as double) y2 from fx_base),
anchor_gt as (select v image, cast(k as bigint) gt_id, cast(c0 as double) x1, cast(r0 as double) y1, cast(c0+w as double) x2,
                     cast(r0+h as double) y2 from fx_gtc),
paths as (
  select concat('/cases/', n, '/DATA/DATA_', volume_id, '.nrrd') path, volume_id id, 'DATA' kind
  from (select volume_id, unnest(range(1, case when volume_id%11=5 then 3 else 2 end)) n from vols)
  union all
  select concat('/cases/1/MASK/MASK_', volume_id, '.nrrd'), volume_id, 'MASK' from vols where volume_id%7<>3),
"""


def inter2(a: str, b: str) -> str:
    return (f"greatest(0.0::double, least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))"
            f"*greatest(0.0::double, least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1))")


def iou2(a: str, b: str) -> str:
    i = inter2(a, b)
    u = f"(({a}.x2-{a}.x1)*({a}.y2-{a}.y1)+({b}.x2-{b}.x1)*({b}.y2-{b}.y1)-{i})"
    return f"(case when {u}>0 then {i}/{u} else 0.0::double end)"


AX = (("coordX", "x_length"), ("coordY", "y_length"), ("coordZ", "z_length"))


def iou3(a: str, b: str) -> str:
    over = [f"(least({a}.{c}+{a}.{e}/2,{b}.{c}+{b}.{e}/2)-greatest({a}.{c}-{a}.{e}/2,{b}.{c}-{b}.{e}/2))" for c, e in AX]
    i = "*".join(over)
    vol = lambda t: f"{t}.x_length*{t}.y_length*{t}.z_length"
    return f"(case when least({','.join(over)})<=0 then 0.0::double else {i}/({vol(a)}+{vol(b)}-{i}) end)"


PAIRS = f"""
pairs as (select p.pred_id, p.public_id, p.probability, g.label_id, {iou3('p', 'g')} iou from pred p join gt_boxes g using (public_id)),
pbest as (select pred_id, public_id, probability, label_id hit_label, iou max_iou from
          (select *, row_number() over (partition by pred_id order by iou desc, label_id) rn from pairs) where rn=1),
scored as (select p.*, p.probability score_max, b.max_iou iou_gt from pred p join pbest b using (pred_id)),
allvol as (select distinct public_id from gt_boxes),
"""
MATCH = f"""
gm as (select g.volume_id, g.slice_z, g.component_id, sqrt((g.x2-g.x1)*(g.x2-g.x1)+(g.y2-g.y1)*(g.y2-g.y1)) diag,
              coalesce(max({iou2('g', 'd')}), 0) best_iou
       from gt2 g left join (select * from det where score>=0.05) d on d.volume_id=g.volume_id and d.slice_z=g.slice_z
       group by g.volume_id, g.slice_z, g.component_id, diag),
fired as (select g.volume_id, g.slice_z, cast(exists(select 1 from det d where d.volume_id=g.volume_id and d.slice_z=g.slice_z
                                                     and d.score>=0.05) as bigint) fired
          from (select distinct volume_id, slice_z from gt_slices) g),
"""
CURVE = """
thr as (select cast(i as double)*cast(0.005 as double) p_thresh from range(200) t(i)),
sizes as (select count(distinct public_id) n_vol, count(*) n_gt from gt_boxes),
cnt as (select t.p_thresh,
               count(distinct case when b.max_iou>0.3 then b.public_id*1000+b.hit_label end) tp,
               count(case when b.max_iou<=0.3 then 1 end) fp
        from thr t left join pbest b on b.probability>=t.p_thresh group by 1),
curve as (select p_thresh, (fp+1e-8)/(n_vol+1e-8) fp, (tp+1e-8)/(n_gt+1e-8) recall from cnt cross join sizes),
keyfp as (select unnest([0.125,0.25,0.5,1.0,2.0,4.0,8.0])::double key_fp),
"""


def at_keys(curve: str, by: str = "") -> str:
    """Interpolated recall at each key FP of a curve table (optionally per group)."""
    g = f"{by}, " if by else ""
    on = f"and a.{by}=g.{by}" if by else ""
    groups = f"(select distinct {by} from {curve})" if by else "(select 1 as one)"
    sel = lambda cond, order: (f"(select {{v}} from {curve} a where a.fp {cond} k.key_fp {on} order by a.fp {order}, a.p_thresh {order} limit 1)")
    lo, hi = sel("<=", "desc"), sel(">=", "asc")
    return f"""select {('g.' + by + ', ') if by else ''}key_fp,
      case when f0 is null then 0.0::double when f1 is null then top else r0+(r1-r0)*((key_fp-f0)/(f1-f0+1e-8)) end recall
      from (select {('g.' + by + ', ') if by else ''}k.key_fp, {lo.format(v='a.fp')} f0, {lo.format(v='a.recall')} r0,
            {hi.format(v='a.fp')} f1, {hi.format(v='a.recall')} r1,
            (select max(a.recall) from {curve} a where true {on}) top
            from keyfp k cross join {groups} g) {'g' if by else 'x'}"""


def greedy(src: str, keys: str, rank: str, row_id: str, cols: str, conflict: str) -> str:
    """Sequential keep-the-best suppression as a recursion over the rank within each group."""
    fields = ", ".join(f"'{c}': r.{c}" for c in cols.split())
    return f"""
ranked as (select *, row_number() over (partition by {keys} order by {rank}) rn from {src}),
walk as (
  select {keys}, rn, [{{{fields}, 'id': r.{row_id}}}] kept from ranked r where rn=1
  union all
  select {', '.join('r.' + k.strip() for k in keys.split(','))}, r.rn,
         case when len(list_filter(w.kept, lambda k: {conflict}))>0 then w.kept
              else list_append(w.kept, {{{fields}, 'id': r.{row_id}}}) end
  from walk w join ranked r on {' and '.join(f'r.{k.strip()}=w.{k.strip()}' for k in keys.split(','))} and r.rn=w.rn+1),
last as (select {keys}, kept from walk qualify row_number() over (partition by {keys} order by rn desc)=1),
keep as (select {keys}, unnest(kept).id as {row_id} from last),
"""


SQL: dict[str, str] = {}


def add(key: str, body: str, doubles: str = "", ctes: str = "") -> None:
    """``body`` is the final select; its DOUBLE columns are rounded to 6 places."""
    rep = ", ".join(f"round({c}, 6)+0.0::double as {c}" for c in doubles.split())
    head = "with recursive " + BASE + ctes + f" final as ({body})\n"
    SQL[key] = head + (f"select * replace ({rep}) from final" if rep else "select * from final")


B4, B6 = "x1 y1 x2 y2", "coordX coordY coordZ x_length y_length z_length"
B4c, B6c = B4.replace(" ", ", "), B6.replace(" ", ", ")

# ---------------------------------------------------------------- A
add("s1", f"select det_id, volume_id, slice_z, {B4c}, score from det", B4 + " score")
SQL["s2"] = SQL["s1"]
add("s3", """select count(*) n_rows, count(*) filter (det_id is null) det_id_null, count(*) filter (volume_id is null) volume_id_null,
  count(*) filter (slice_z is null) slice_z_null, count(*) filter (x1 is null) x1_null, count(*) filter (y1 is null) y1_null,
  count(*) filter (x2 is null) x2_null, count(*) filter (y2 is null) y2_null, count(*) filter (score is null) score_null,
  count(*) filter (not x1<x2) x_order, count(*) filter (not y1<y2) y_order,
  count(*) filter (not (score>=0 and score<=1)) score_range from dirty""")
add("s5", f"select public_id, {B6c} from gt_boxes", B6)
add("s6", "select volume_id case_id, label from manifest")
add("s7", "select volume_id, slice_z, r0, c0, r1, c1, component_id from gt_slices")
add("s8", "select * exclude (cand_seq) from record",
    B6 + " score_max score_mean score_std score_min fill_ratio centroid_jitter area_cv rank_norm iou_gt cen_d0 cen_d1 cen_d2 ext_d0 ext_d1 ext_d2")
add("s9", f"select candidate_id, public_id, {B6c}, score_max probability from record", B6 + " probability")
add("s10", f"select public_id, {B6c}, score_max probability, detector_of_origin from record where split='val'", B6 + " probability")
PC = """
pc as (select id case_id, min(case when kind='DATA' then path end) as data, min(case when kind='MASK' then path end) mask,
              count(*) filter (kind='DATA') n_data, count(*) filter (kind='MASK') n_mask from paths group by 1),
pp as (select *, case when n_data>1 or n_mask>1 then 'duplicate' when n_data=0 or n_mask=0 then 'unmatched' end problem from pc),
"""
add("s11", "select * from pp", "", PC)
add("s12", "select volume_id, count(*) n, max(score) top from det group by 1", "top")
add("s13", "select run*100+epoch epoch, cpm val_ap_2d, ceiling recall_at_1 from epoch_log", "val_ap_2d recall_at_1")
add("s14", "select preprocess_hash, count(*) n from record where preprocess_hash<>'new' group by 1")
add("s15", "select concat('t', det_id%2) tag, volume_id, count(*) n, max(score) top from det group by 1, 2", "top")
add("s15_stream", "select det_id, volume_id, slice_z, x1, y1, x2, y2, score from dirty where x1<x2 and y1<y2 and score>=0 and score<=1",
    B4 + " score")
add("s16", "select * from manifest where split='val'")
# ---------------------------------------------------------------- B
add("p1", "select det_id, score from det where score>=0.5", "score")
add("p2", f"select det_id, {B4c} from dirty where x2>x1 and y2>y1", B4)
add("p3", f"select volume_id, slice_z, component_id, {B4c} from gt2", B4)
add("p4", """select volume_id, slice_z, component_id, (slice_z+slice_z+3)/cast(2 as double) coordX, (c0+c1)/cast(2 as double) coordY,
  (r0+r1)/cast(2 as double) coordZ, cast(3 as double) x_length, cast(c1-c0 as double) y_length, cast(r1-r0 as double) z_length from gt_slices""", B6)
RE = lambda x: f"cast(round_even({x}, 0) as bigint)"
add("p5", "select pred_id, " + ", ".join(f"{RE(f'{c}{s}{e}/2')} {n}_d{i}" for n, s in (("min", "-"), ("max", "+"))
                                          for i, (c, e) in ((0, AX[2]), (1, AX[1]), (2, AX[0]))) + " from pred")
ZF = ["(cast(0.073 as double)/cast(0.4 as double))", "(cast(0.2 as double)/cast(0.4 as double))", "(cast(0.475674 as double)/cast(0.4 as double))"]
add("p6", "select volume_id, slice_z, component_id, " + ", ".join(
    f"{RE(f'({src}+0.5::double)/{ZF[int(n[-1])]}-0.5::double')} {n}" for n, src in
    (("min_d0", "r0"), ("min_d1", "c0"), ("min_d2", "slice_z"), ("max_d0", "r1"), ("max_d1", "c1"), ("max_d2", "(slice_z+3)"))) + " from gt_slices")
add("p7", "select volume_id, " + ", ".join(f"{z} f{i}" for i, z in enumerate(ZF)) + ", " + ", ".join(
    f"{RE(f'({s})*{z}')} n{i}" for i, (s, z) in enumerate(zip(("800+volume_id%90", "600+volume_id%70", "300+volume_id%50"), ZF)))
    + " from vols", "f0 f1 f2")
add("p8", f"select d.det_id, g.component_id, {iou2('d', 'g')} iou from det d join gt2 g using (volume_id, slice_z) where {iou2('d', 'g')}>0", "iou")
add("p9", "select pred_id, label_id, iou from pairs where iou>0", "iou", PAIRS)
add("p10", "select cand_seq, iou_gt, case when iou_gt>0.3 then 'pos' when iou_gt<0.1 then 'neg' else 'ignore' end as label from record", "iou_gt")
GAP = "sqrt(cast(power(greatest(0, a.r0-b.r1-1, b.r0-a.r1-1), 2)+power(greatest(0, a.c0-b.c1-1, b.c0-a.c1-1), 2) as double))"
add("p11", f"""select a.volume_id, a.slice_z, {GAP} gap from gt_slices a join gt_slices b using (volume_id, slice_z)
  where a.component_id=0 and b.component_id=1""", "gap")
add("p12", """select det_id, (x1+x2)/2 cx, (y1+y2)/2 cy, x2-x1 w, y2-y1 h, (x2-x1)*(y2-y1) area,
  sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) diag, (y2-y1)/(x2-x1) aspect,
  sqrt(p.x_length*p.x_length+p.y_length*p.y_length+p.z_length*p.z_length) diag_3d from det join pred p on p.pred_id=det_id""",
    "cx cy w h area diag aspect diag_3d")
ANISO = "case when ext_d1+ext_d2>0 then ext_d0/((ext_d1+ext_d2)/2) end"
add("p13", f"select cand_seq, {ANISO} anisotropy from record", "anisotropy")
add("p14", "select e det_id, least(value/cast(100 as double), cast(0.999999 as double)) p from fx_base", "p")
add("p15", "select det_id, 160-x2 x1, y1, 160-x1 x2, y2 from det", B4)
CLIP = lambda x, hi: f"least(greatest({x}, 0.0::double), {hi}.0::double)"


def moved(fx: str, fy: str) -> str:
    e = {"x1": CLIP(fx.format("x1"), 160), "y1": CLIP(fy.format("y1"), 110), "x2": CLIP(fx.format("x2"), 160), "y2": CLIP(fy.format("y2"), 110)}
    return "select * from (select det_id, " + ", ".join(f"{v} {k}" for k, v in e.items()) + " from det) where x2>x1 and y2>y1"


add("p16", moved("({}-31)", "({}+9)"), B4)
add("p17", moved("(80+({}-80)*cast(1.25 as double))", "(55+({}-55)*cast(1.25 as double))"), B4)
CS, SN = "cos(radians(cast(7 as double)))", "sin(radians(cast(7 as double)))"
ROT_X = ", ".join(f"{CS}*({x}-80)-{SN}*({y}-55)+80" for x in ("x1", "x2") for y in ("y1", "y2"))
ROT_Y = ", ".join(f"{SN}*({x}-80)+{CS}*({y}-55)+55" for x in ("x1", "x2") for y in ("y1", "y2"))
add("p18", f"""select * from (select det_id, {CLIP(f'least({ROT_X})', 160)} x1, {CLIP(f'least({ROT_Y})', 110)} y1,
  {CLIP(f'greatest({ROT_X})', 160)} x2, {CLIP(f'greatest({ROT_Y})', 110)} y2 from det) where x2>x1 and y2>y1""", B4)
add("p19", """select volume_id, n0, n1, n2, round(n0*cast(0.073 as double),1) ext0, round(n1*cast(0.2 as double),1) ext1,
  round(n2*cast(0.475674 as double),1) ext2, n0>=n1 and n1>=n2 ordered from frames""", "ext0 ext1 ext2")
BUCKETS = """
buckets as (select * from (values (0,'[0,16)',0.0,16.0), (1,'[16,32)',16.0,32.0), (2,'[32,64)',32.0,64.0), (3,'[64,128)',64.0,128.0),
                                  (4,'[128,inf)',128.0,1e18)) t(i, bucket, lo, hi)),
"""
add("p20", """select bucket, count(g.diag) n from buckets left join
  (select sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) diag from gt2) g on g.diag>=lo and g.diag<hi group by 1""", "", BUCKETS)
add("p21", "select volume_id, split from manifest")
add("p22", """select volume_id, volume_id case_id, case when volume_id%2=0 then volume_id%5 else -1 end fold,
  concat(case when volume_id%2=0 then concat('fold', volume_id%5) else 'full_seed1' end, ':', volume_id, ':7') candidate_id from vols""")
add("p23", """select e event_id, cast(ceil(value/32)*32 as bigint) up,
  (select g from (select unnest([0.2,0.25,0.33,0.5,0.75,1.0,1.5,2.0])::double g) order by abs(value/cast(100 as double)-g), g limit 1) snap
  from fx_base""", "snap")
# ---------------------------------------------------------------- C
add("j1", "select volume_id, slice_z, component_id, diag, best_iou from gm", "diag best_iou", MATCH)
add("j2", """select sum(f)::bigint fired, count(*) lesion_slices, sum(f)/count(*)::double rate from (
  select cast(exists(select 1 from det d where d.volume_id=g.volume_id and d.slice_z=g.slice_z and d.score>=0.5) as bigint) f
  from (select distinct volume_id, slice_z from gt_slices) g)""", "rate")
add("j3", "select pred_id, hit_label, max_iou from pbest where max_iou>0", "max_iou", PAIRS)
add("j4", f"""select a.det_id a, b.det_id b, {iou2('a', 'b')} iou from det a join det b on a.volume_id=b.volume_id
  and b.slice_z in (a.slice_z+1, a.slice_z+2) where {iou2('a', 'b')}>=0.3""", "iou")
add("j5", """select g.volume_id, count(d.det_id) n_fire, count(distinct d.slice_z) n_slices_fired, g.max_d2-g.min_d2+1 gt_n_slices,
  coalesce(max(d.score), 0) max_score from gt_iso g left join det d on d.volume_id=g.volume_id and d.slice_z between g.min_d2 and g.max_d2
  and least(d.x2, g.max_d1+1)>greatest(d.x1, g.min_d1) and least(d.y2, g.max_d0+1)>greatest(d.y1, g.min_d0)
  group by g.volume_id, g.min_d2, g.max_d2""", "max_score")
add("j6", "select case_id, data, mask from pp where problem='unmatched'", "", PC)
add("j7", "select distinct public_id from pred where public_id not in (select public_id from gt_boxes where label_id=2)")
add("j8", """select volume_id, concat('fold', fold) detector_of_origin, split, fold from manifest where split='train'
  union all select volume_id, concat('full_seed', s), split, fold from manifest cross join range(3) t(s) where split<>'train'""")
add("j8_train", "select volume_id from manifest where split='train' and fold<>2")
add("j9", """select *, greatest(d_coordX, d_coordY, d_coordZ, d_x_length, d_y_length, d_z_length) max_diff from (
  select g.public_id, abs((i.min_d2+i.max_d2)/2.0::double-g.coordX) d_coordX, abs((i.min_d1+i.max_d1)/2.0::double-g.coordY) d_coordY,
  abs((i.min_d0+i.max_d0)/2.0::double-g.coordZ) d_coordZ, abs(i.max_d2-i.min_d2-g.x_length) d_x_length,
  abs(i.max_d1-i.min_d1-g.y_length) d_y_length, abs(i.max_d0-i.min_d0-g.z_length) d_z_length
  from gt_iso i join gt_boxes g on g.public_id=i.volume_id)""",
    "d_coordX d_coordY d_coordZ d_x_length d_y_length d_z_length max_diff")
DIST = "sqrt((a.cen_d0-b.cen_d0)*(a.cen_d0-b.cen_d0)+(a.cen_d1-b.cen_d1)*(a.cen_d1-b.cen_d1)+(a.cen_d2-b.cen_d2)*(a.cen_d2-b.cen_d2))"
add("j10", f"select a.cand_seq, min({DIST}) nn_dist from record a join record b on a.label=b.label and a.cand_seq<>b.cand_seq group by 1", "nn_dist")
# IoU >= mean + std, exactly: in whole multiples of 1e-9, so that equal competitors all reach it
add("j11", "select image, anchor_id, gt_id, iou from pos qualify row_number() over (partition by image, anchor_id order by iou desc, gt_id)=1", "iou", f"""
ac as (select a.image, g.gt_id, a.level, a.anchor_id, {iou2('g', 'a')} iou,
  sqrt(((g.x1+g.x2)/2-(a.x1+a.x2)/2)*((g.x1+g.x2)/2-(a.x1+a.x2)/2)+((g.y1+g.y2)/2-(a.y1+a.y2)/2)*((g.y1+g.y2)/2-(a.y1+a.y2)/2)) d,
  (a.x1+a.x2)/2 between g.x1 and g.x2 and (a.y1+a.y2)/2 between g.y1 and g.y2 inside from anchors a join anchor_gt g using (image)
  qualify row_number() over (partition by a.image, g.gt_id, a.level order by d, a.anchor_id)<=3),
pos as (select * from (select *, (count(*) over w)*x-(sum(x) over w) over_mean, (count(*) over w)*(sum(x*x) over w)-(sum(x) over w)*(sum(x) over w) spread
    from (select *, cast(round(iou*1e9::double) as hugeint) x from ac) window w as (partition by image, gt_id))
  where over_mean>=0 and over_mean*over_mean>=spread and inside),""")
add("j12", """select bucket, count(*) n, avg((n_anchors=0)::int) frac_zero,
  (select k from (select n_anchors k, count(*) c from cov c2 where c2.bucket=c1.bucket group by 1) order by c desc, k limit 1) as mode,
  quantile_cont(n_anchors::double, 0.5) median, avg((n_anchors=0)::int)<=0.05 ok from cov c1 group by bucket""", "frac_zero median", BUCKETS + f"""
cov as (select g.image, g.gt_id, b.bucket, count(a.anchor_id) n_anchors from anchor_gt g
  join buckets b on sqrt((g.x2-g.x1)*(g.x2-g.x1)+(g.y2-g.y1)*(g.y2-g.y1))>=b.lo and sqrt((g.x2-g.x1)*(g.x2-g.x1)+(g.y2-g.y1)*(g.y2-g.y1))<b.hi
  left join anchors a on a.image=g.image and {iou2('g', 'a')}>=0.2 group by 1, 2, 3),""")
add("j13", """select s.volume_id, s.slice_z, o as "offset", greatest(0, least(11, s.slice_z+o)) source_z, coalesce(t.n, 0) n, t.top
  from slice_stats s cross join range(-1, 2) r(o) left join slice_stats t on t.volume_id=s.volume_id and t.slice_z=greatest(0, least(11, s.slice_z+o))""",
    "top")
add("j14", """select count(*) filter (public_id%11<>0) n_pairs, 2*count(*) filter (public_id%11=0) n_unpaired,
  count(*) filter (public_id%11<>0 and public_id%5=0 and score_max/2>1e-9) n_mismatch from record""")
add("j15", """select volume_id, z slice_z, exists(select 1 from gt_slices g where g.volume_id=v.volume_id and g.slice_z=z) is_lesion
  from vols v cross join range(12) t(z)""")
# ---------------------------------------------------------------- D
add("a1", """select volume_id, tube_id, max(score) score_max, avg(score) score_mean, stddev_pop(score) score_std, min(score) score_min,
  count(*) slice_count, max(slice_z)-min(slice_z)+1 z_span, count(*)/(max(slice_z)-min(slice_z)+1)::double fill_ratio
  from members group by 1, 2""", "score_max score_mean score_std score_min fill_ratio")
STEP = """
steps as (select *, (x2-x1)*(y2-y1) area, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) diag,
  sqrt(power((x1+x2)/2-lag((x1+x2)/2) over w, 2)+power((y1+y2)/2-lag((y1+y2)/2) over w, 2)) step
  from members window w as (partition by volume_id, tube_id order by slice_z, det_id)),
"""
add("a2", """select volume_id, tube_id, case when count(*)>1 then avg(step)/(avg(diag)+1e-6) else 0 end centroid_jitter,
  case when count(*)>1 then stddev_pop(area)/(avg(area)+1e-6) else 0 end area_cv from steps group by 1, 2""", "centroid_jitter area_cv", STEP)
HULL = f"""
hull as (select volume_id, tube_id, {RE('min(y1)')} min_d0, {RE('min(x1)')} min_d1, min(slice_z) min_d2,
  {RE('max(y2)')}-1 max_d0, {RE('max(x2)')}-1 max_d1, max(slice_z) max_d2 from members group by 1, 2),
"""
add("a3", "select *, " + ", ".join(f"(min_d{i}+max_d{i})/2.0::double cen_d{i}" for i in range(3)) + ", " + ", ".join(
    f"cast(max_d{i}-min_d{i} as double) ext_d{i}" for i in range(3)) + " from hull", "cen_d0 cen_d1 cen_d2 ext_d0 ext_d1 ext_d2", HULL)


def native(src: str, keep: str) -> str:
    z = ("0.5", "0.5", "1.0")
    n = ", ".join(f"{RE(f'({m}_d{i}+0.5::double)/{z[i]}::double-0.5::double')} {m}{i}" for m in ("min", "max") for i in range(3))
    return f"""(select {keep}, (min2+max2)/2.0::double coordX, (min1+max1)/2.0::double coordY, (min0+max0)/2.0::double coordZ,
      cast(max2-min2 as double) x_length, cast(max1-min1 as double) y_length, cast(max0-min0 as double) z_length
      from (select {keep}, {n} from {src}))"""


add("a4", f"select * from {native('hull', 'volume_id, tube_id')}", B6, HULL)
add("a5", "select volume_id, min(d0) min_d0, min(d1) min_d1, min(d2) min_d2, max(d0) max_d0, max(d1) max_d1, max(d2) max_d2 from voxels group by 1")
add("a6", """select volume_id, d2 slice_z, min(d1)::double x1, min(d0)::double y1, (max(d1)+1)::double x2, (max(d0)+1)::double y2
  from voxels group by 1, 2""", B4)
CONSIST = f"""
rec as {native('gt_iso', 'volume_id')},
consist as (select r.volume_id public_id, coalesce(max({iou3('r', 'g')}), 0) recon_iou from rec r left join gt_boxes g on g.public_id=r.volume_id group by 1),
"""
add("a7", "select * from consist", "recon_iou", CONSIST)
POOL = """
pool as (select v.public_id, count(s.pred_id) n, coalesce(max((s.iou_gt>0.3)::int), 0) h from allvol v left join scored s using (public_id) group by 1),
"""
add("a8", """select avg(h) recall, sum(h)::bigint n_hit, count(*) n_vol, avg(n) pool_mean, quantile_cont(n::double, 0.5) pool_median,
  max(n) pool_max, sum(n)::bigint pool_total from pool""", "recall pool_mean pool_median", PAIRS + POOL)
BREAK = """
brk as (
  select 'iou' as section, t::varchar as label, count(*) n, count(*) filter (best_iou>t::double) hits from gm cross join (select unnest([0.1,0.2,0.3]) t) group by t
  union all select 'size', bucket, count(diag), count(*) filter (best_iou>0.3) from buckets left join gm on diag>=lo and diag<hi group by bucket
  union all select 'fire', 'slices', count(*), sum(fired)::bigint from fired),
brk2 as (select *, case when n>0 then hits/n::double end recall from brk),
"""
add("a9", "select * from brk2", "recall", BUCKETS + MATCH + BREAK)
HITS = """
hits as (select v.volume_id, count(distinct case when best_iou>0.3 then slice_z end) hit_slices from vols v left join gm using (volume_id) group by 1),
missed as (select g.volume_id, count(*) n_gt_boxes, max(diag) max_gt_diag, max(best_iou) best_iou,
  (select avg(fired) from fired f where f.volume_id=g.volume_id) fired_frac from gm g group by 1 having max(best_iou)<=0.3),
"""
add("a10", "select * from hits", "", MATCH + HITS)
add("a11", "select * from missed", "max_gt_diag best_iou fired_frac", MATCH + HITS)
add("a12", """select sum(h)/sum(n)::double per_slice_recall, avg((h>0)::int) per_volume_recall from
  (select volume_id, count(*) n, count(*) filter (best_iou>=0.3) h from gm group by 1)""", "per_slice_recall per_volume_recall", MATCH)
PCT = lambda c, qs: ", ".join(f"quantile_cont({c}, {q / 100}) p{q}" for q in qs)
SUMQ = (0, 10, 25, 50, 75, 90, 100)
add("a13", f"""select metric, is_tp, {PCT('v', SUMQ)}, avg(v) mean, count(*) n from (
  select 'score_max' metric, iou_gt>0.3 is_tp, score_max v from scored union all
  select 'box_diag', iou_gt>0.3, sqrt(x_length*x_length+y_length*y_length+z_length*z_length) from scored) group by 1, 2""",
    " ".join(f"p{q}" for q in SUMQ) + " mean", PAIRS)
add("a14", """select (select avg((score_max<(select quantile_cont(score_max, 0.5) from sep where tp))::int) from sep where not tp) frac_fp_below_tp_median,
  ba best_balacc, t best_thresh, (select min(score_max) from sep where tp) tp_min from
  (select t, 0.5::double*((select count(*) from sep where tp and score_max>=t)/(select count(*) from sep where tp)::double
            +(select count(*) from sep where not tp and score_max<t)/(select count(*) from sep where not tp)::double) ba
   from (select distinct score_max t from sep)) order by ba desc, t limit 1""",
    "frac_fp_below_tp_median best_balacc best_thresh tp_min", PAIRS + "sep as (select score_max, iou_gt>0.3 tp from scored),")
CLIFF = lambda src, a, b: (f"(select (sum((x.v>y.v)::bigint)-sum((x.v<y.v)::bigint))/count(*)::double from "
                           f"(select v from {src} where {a}) x cross join (select v from {src} where {b}) y)")
add("a15", f"select {CLIFF('an', 'label=$$neg$$', 'label=$$pos$$')} delta", "delta",
    f"an as (select label, v from (select label, {ANISO} v from record) where v is not null),")
QS4 = lambda c: f"quantile_cont({c}, 0.5), quantile_cont({c}, 0.25), quantile_cont({c}, 0.75)"
DQ = (1, 5, 10, 25, 50, 75, 90, 95, 99, 100)
TRAIN = """
tb as (select volume_id, slice_z, (r1-r0+1)::double h, (c1-c0+1)::double w from gt_slices where volume_id in (select volume_id from manifest where split='train')),
tb2 as (select *, sqrt(h*h+w*w) diag, h/w aspect from tb),
tf as (select * from frames where volume_id in (select volume_id from manifest where split='train')),
"""
add("a17", "select (select count(*) from tf) n_train_volumes, " + ", ".join(
    f"(select {f} from tf) frame_d{i}_{n}" for i in range(2) for n, f in
    (("min", f"min(n{i})"), ("max", f"max(n{i})"), ("median", f"quantile_cont(n{i}::double, 0.5)"))) +
    ", (select count(*) from tb) n_boxes, (select max(c) from (select count(*) c from tb group by volume_id, slice_z)) components_per_slice_max, "
    "(select avg((c>1)::int) from (select count(*) c from tb group by volume_id, slice_z)) components_per_slice_frac_gt1, " + ", ".join(
    f"(select quantile_cont({c}, {q / 100}) from tb2) {n}_{q}" for n, c in (("box_h_pct", "h"), ("box_w_pct", "w"), ("diag_pct", "diag"), ("aspect_pct", "aspect")) for q in DQ),
    "frame_d0_median frame_d1_median components_per_slice_frac_gt1 " + " ".join(f"{n}_{q}" for n in ("box_h_pct", "box_w_pct", "diag_pct", "aspect_pct") for q in DQ), TRAIN)
POOLED = "select count(*) n_slices, sum(n*mean)/sum(n) intensity_mean, sqrt(greatest(sum(sumsq)/sum(n)-power(sum(n*mean)/sum(n), 2), 0)) intensity_std from {}"
add("a18", POOLED.format("slice_stats"), "intensity_mean intensity_std")
add("a18_sample", POOLED.format("(select * from slice_stats order by md5('3:'||volume_id||':'||slice_z), volume_id, slice_z limit 1000)"),
    "intensity_mean intensity_std")
add("a19", """select cast(ceil(d0/32.0)*32 as bigint) min_size, cast(ceil(d1/32.0)*32 as bigint) max_size,
  array_to_string([cast(b*power(2, oct+i) as bigint) for i in range(5)], ',') bases,
  array_to_string(list_transform(list_sort(list_distinct([a10, a50, a90, 1.0::double])), lambda x: printf('%.2f', x)), ',') aspects
  from (select *, greatest(0, ceil(log2(hi/power(2, 2.0/3.0)/(b*16)))) oct from (
    select (select max(n0) from tf) d0, (select max(n1) from tf) d1, least(power(2, round_even(log2(quantile_cont(diag, 0.01)), 0)), 16) b,
    quantile_cont(diag, 0.99) hi, """ + ", ".join(
    f"(select g from (select unnest([0.2,0.25,0.33,0.5,0.75,1.0,1.5,2.0])::double g) order by abs((select quantile_cont(aspect, {q / 100}) from tb2)-g), g limit 1) a{q}"
    for q in (10, 50, 90)) + " from tb2))", "", TRAIN)
CAPS = f"""
caps0 as (select (select quantile_cont(z::double, 0.99) from (select max(slice_z)-min(slice_z)+1 z from gt_slices group by volume_id)) zspan_p99,
  (select quantile_cont(greatest(c1-c0+1, r1-r0+1)::double, 0.99) from gt_slices) inplane_extent_p99),
caps as (select *, {RE('zspan_p99*cast(1.8 as double)')} max_tube_zspan, {RE('inplane_extent_p99*cast(1.5 as double)')} max_centroid_drift from caps0),
"""
add("a20", "select * from caps", "zspan_p99 inplane_extent_p99", CAPS)
# two lesion prisms are one component exactly when no empty cell lies between them on either axis
COMP = f"""
box as (select volume_id, component_id, min(r0) r0, min(c0) c0, max(r1) r1, max(c1) c1, (max(r1)-min(r0)+1)*(max(c1)-min(c0)+1)*10 vox from gt_slices group by 1, 2),
comp as (select volume_id, vox n_voxels from box where volume_id not in (select a.volume_id from box a join box b using (volume_id) where a.component_id<b.component_id and {GAP}=0)
  union all select volume_id, sum(vox)::bigint from box where volume_id in (select a.volume_id from box a join box b using (volume_id) where a.component_id<b.component_id and {GAP}=0) group by 1),
"""
add("a21", """select k n_components, (select count(*) from au where raw=k) raw_volumes, (select count(*) from au where kept=k) kept_volumes,
  (select avg((kept=1)::int) from au) single_share, (select avg((kept=1)::int) from au)>=0.9 single_dominant
  from (select raw k from au union select kept from au)""", "single_share", COMP + """
au as (select volume_id, count(*) raw, count(*) filter (n_voxels>=3000) kept from comp group by 1),""")
add("a22", """select count(*) n, min(recon_iou) as min, quantile_cont(recon_iou, 0.1) p10, quantile_cont(recon_iou, 0.5) median,
  max(recon_iou) as max, count(*) filter (recon_iou<0.85) n_below_warn, count(*) filter (recon_iou<0.5) n_below_floor,
  avg((recon_iou>=0.85)::int::double) soft_share,
  case when count(*) filter (recon_iou<0.5)=0 and avg((recon_iou>=0.85)::int::double)>=0.85 then 'PASS' else 'FAIL' end verdict
  from consist""", "min p10 median max soft_share", CONSIST)
add("a23", """select 3 as level, split, null::varchar as label, null::varchar as fold, count(*) n from manifest group by split
  union all select 1, split, label, null, count(*) from manifest group by split, label
  union all select 6, null, null, fold::varchar, count(*) from manifest group by fold""")
add("a23_slices", """select split, 12*count(*) n_slices, 10*count(*) n_lesion, 2*count(*) n_background from manifest group by 1""")
add("a23_labels", "select detector_of_origin, label, count(*) n, count(distinct public_id) n_volumes from record group by 1, 2")
add("a24", "select epoch, avg(cpm) cpm_mean, stddev_pop(cpm) cpm_std, avg(ceiling) ceiling_mean, stddev_pop(ceiling) ceiling_std from epoch_log group by 1",
    "cpm_mean cpm_std ceiling_mean ceiling_std")
add("a25", """select count(*) n, sum(cast('0x'||substr(s, 1, 12) as hugeint))::varchar h0, sum(cast('0x'||substr(s, 13, 12) as hugeint))::varchar h1
  from (select sha256(volume_id||'|'||split||'|'||fold||'|'||label) s from manifest)""")


def clusters(radius: float) -> str:
    return f"""
near as (select a.public_id, a.cand_seq a, b.cand_seq b from record a join record b on a.public_id=b.public_id and {DIST}<={radius}),
reach as (select public_id, a as start, b as node from near union select r.public_id, r.start, n.b from reach r join near n on n.public_id=r.public_id and n.a=r.node),
lab as (select public_id, node cand_seq, min(start) as cluster from reach group by 1, 2),
"""


add("a26", """select public_id, count(distinct cluster) n_clusters, count(*) n_points, count(*)/count(distinct cluster)::double redundancy
  from lab group by 1""", "redundancy", clusters(10.0))
add("a27", "select sum(n2)::bigint n_slices, avg(n2) mean_slices from frames", "mean_slices")
# ---------------------------------------------------------------- E
add("w1", """select candidate_id, row_number() over w as rank, row_number() over w/(count(*) over (partition by detector_of_origin, public_id))::double rank_norm
  from record window w as (partition by detector_of_origin, public_id order by score_max desc, cand_seq)""", "rank_norm")
add("w2", """select cand_seq tube_id, detector_of_origin,
  row_number() over (partition by detector_of_origin order by public_id, score_max desc, cand_seq)-1 cand_seq from record""")
# a detection touches at most one lesion of its slice here, so the first one per lesion wins it
TP = f"""
tp0 as (select d.det_id, row_number() over (partition by g.volume_id, g.slice_z, g.component_id order by d.score desc, d.det_id) rn
  from det d join gt2 g using (volume_id, slice_z) where {iou2('d', 'g')}>=0.3),
tp as (select d.det_id, d.score, coalesce((select max((t.rn=1)::int) from tp0 t where t.det_id=d.det_id), 0)::bigint is_tp from det d),
run as (select *, sum(is_tp) over w tc, sum(1-is_tp) over w fc from tp window w as (order by score desc, det_id rows unbounded preceding)),
"""
add("w3", """select (select count(*) from gt_slices) n_gt, count(*) n_det, sum(case when is_tp=1 then env end)/(select count(*) from gt_slices) ap from
  (select *, max(tc/(tc+fc)::double) over (order by score, det_id desc rows unbounded preceding) env from run)""", "ap", TP)
add("w4", """select b budget, coalesce((select max(tc) from run where fc<=b*(select 12*count(*) from vols)), 0)/(select count(*) from gt_slices)::double recall
  from (select unnest([0.125,0.25,0.5,1.0,2.0,4.0,8.0])::double b)""", "budget recall", TP)
add("w5", "select det_id, tube_id, step from steps", "step", STEP)
add("w6", """select run, thresh_hi, thresh_lo, recall_hi, recall_lo, recall_hi-recall_lo as "drop" from (
  select run, lag(t) over w thresh_hi, t thresh_lo, lag(ceiling) over w recall_hi, ceiling recall_lo
  from (select *, epoch/cast(100 as double) t from epoch_log) window w as (partition by run order by t desc)) where recall_lo<recall_hi-1e-9""",
    'thresh_hi thresh_lo recall_hi recall_lo "drop"')
add("w7", "select volume_id, label, (row_number() over (partition by label order by md5('0:'||volume_id), volume_id)-1)%5 fold from manifest")
add("w8", f"""select volume_id, slice_z, det_id, iou, coalesce(has and row_number() over (partition by volume_id, slice_z order by iou desc, det_id)=1, false) is_best,
  row_number() over (partition by volume_id, slice_z order by score desc, det_id)<=2 in_top from (
  select d.volume_id, d.slice_z, d.det_id, d.score, g.volume_id is not null has, coalesce({iou2('d', 'g')}, 0) iou from det d
  left join (select volume_id, slice_z, min(x1) x1, min(y1) y1, max(x2) x2, max(y2) y2 from gt2 group by 1, 2) g using (volume_id, slice_z))""", "iou")
add("w9", """select volume_id, slice_z, det_id, score from det
  qualify row_number() over (partition by volume_id, slice_z order by score desc, det_id)<=3""", "score")
add("w10", at_keys("curve"), "key_fp recall", PAIRS + CURVE)
# ---------------------------------------------------------------- F
add("k1", """select l.run, arg_max(l.epoch, row(l.ceiling, -l.epoch)) epoch from epoch_log l
  join (select run, max(cpm) m from epoch_log where epoch>=3 group by 1) b on b.run=l.run where l.epoch>=3 and l.cpm>=b.m-cast(0.02 as double) group by 1""")
add("k1_legacy", "select run, epoch from epoch_log where epoch>=3 qualify row_number() over (partition by run order by cpm desc, epoch desc)=1")
add("k2", """select run, max(cpm)-min(cpm) spread, count(*) n_top from (select * from epoch_log where epoch>=3
  qualify row_number() over (partition by run order by cpm desc, epoch desc)<=3) group by 1""", "spread")
OPS = """
ops as (select t::double thresh, 't='||t config, 'm'||i as method, c/n::double recall, c%97/cast(97 as double) cpm, c::double pool_mean, c pool_max,
    c/(max(c) over ())::double rel from (
  select t, i-1 i, (select count(*) from det where score>=t::double) c, (select count(*) from det) n
  from (select unnest(['0.05','0.1','0.2','0.4','0.6','0.8']) t, generate_subscripts([1,2,3,4,5,6], 1) i))),
"""
add("k3", """select thresh, recall, cpm, pool_mean from ops where recall>=0.5*(select max(recall) from ops)-1e-12
  order by cpm desc, pool_mean, thresh limit 1""", "thresh recall cpm pool_mean", OPS)
add("k4", """select config, recall, pool_mean, rel pool_max, (select max(recall) from ops where rel<=0.7) best_in_budget_recall from ops
  where rel<=0.7 and recall>=0.3-1e-9 order by pool_mean, config limit 1""", "recall pool_mean pool_max best_in_budget_recall", OPS)
add("k5", """select method, recall, rel pool_mean from ops where rel<=0.7 and recall>=0.3 order by recall desc, rel, method limit 1""",
    "recall pool_mean", OPS)
add("k6", "select thresh, recall from ops where recall>=0.5*(select max(recall) from ops) order by thresh desc limit 1", "thresh recall", OPS)
add("k7", """select volume_id, slice_z, is_lesion, row_number() over (order by o, volume_id, slice_z)-1 pos_in_epoch from (
  select *, row_number() over (partition by is_lesion order by o, volume_id, slice_z) rn, count(*) filter (is_lesion) over () np from (
    select *, md5('5:2:'||volume_id||':'||slice_z) o from (
      select volume_id, z slice_z, z between 1 and 10 is_lesion from vols cross join range(12) t(z))))
  where is_lesion or rn<=np""")
# ---------------------------------------------------------------- G
add("u1", "select det_id, score, 'full_seed'||s detector from det cross join range(3) t(s)", "score")
add("u2", """select public_id, 'left' as side from (select public_id from pred except select public_id from gt_boxes)
  union all select public_id, 'right' from (select public_id from gt_boxes except select public_id from pred)""")
add("u3", """select distinct volume_id, slice_z, 'right' as side from gt_slices where volume_id%13=0
  union all select distinct volume_id+3000000, slice_z, 'left' from gt_slices where volume_id%13=0""")
add("u4", """select v.public_id, """ + ", ".join(f"coalesce(max((s.iou_gt>0.3 and s.score_max>={t})::int), 0) c{i}" for i, t in enumerate((0.6, 0.4, 0.1))) +
    " from allvol v left join scored s using (public_id) group by 1 having coalesce(max((s.iou_gt>0.3 and s.score_max>=0.6)::int), 0)=0", "", PAIRS)
# ---------------------------------------------------------------- H
K2 = "k"
INT2 = inter2("k", "r")
# one action per step: extend the tube, turn round, or take the next free seed
PAR = "lpar as (select distinct g, 0.3::double iou, 3 len, 182 span from ldet),"
LINKED = f"""
lr as (select *, row_number() over (partition by g, volume_id order by slice_z, x1, y1, x2, y2, det_id) p,
    row_number() over (partition by g, volume_id order by score desc, slice_z, x1, y1, x2, y2, det_id) k from ldet),
ledge as (select a.g, a.volume_id, a.p, b.p c, b.slice_z>a.slice_z up, {iou2('a', 'b')} iou
  from lr a join lr b on a.g=b.g and a.volume_id=b.volume_id and abs(a.slice_z-b.slice_z) between 1 and 2 join lpar on lpar.g=a.g
  where {iou2('a', 'b')}>=lpar.iou),
lway as (select g, volume_id, p, list(c order by iou desc, c) filter (up) u, list(c order by iou desc, c) filter (not up) d from ledge group by 1, 2, 3),
lvol as (select lr.g, lr.volume_id, list(p order by k) seeds, list((x1+x2)/2 order by p) xs, list((y1+y2)/2 order by p) ys, list(slice_z order by p) zs,
    list(coalesce(u, []::bigint[]) order by p) us, list(coalesce(d, []::bigint[]) order by p) ds, max(span) span
  from lr left join lway using (g, volume_id, p) join lpar on lpar.g=lr.g group by 1, 2),
lwalk as (
  select g, volume_id, [seeds[1]] used, [seeds[1]] own, seeds[1] seed, seeds[1] head, false down, 1 n, xs[seeds[1]] sx, ys[seeds[1]] sy,
    zs[seeds[1]] z0, zs[seeds[1]] z1, false done from lvol
  union all
  select g, volume_id, case when ok then list_append(used, nxt) when turn and nseed is not null then list_append(used, nseed) else used end,
    case when ok then list_append(own, seed) when turn and nseed is not null then list_append(own, nseed) else own end,
    case when turn and nseed is not null then nseed else seed end,
    case when ok then nxt when turn and nseed is not null then nseed else seed end,
    case when ok then down else not down end, case when ok then n+1 when turn then 1 else n end,
    case when ok then sx+xs[nxt] when turn then xs[nseed] else sx end, case when ok then sy+ys[nxt] when turn then ys[nseed] else sy end,
    case when ok then least(z0, zs[nxt]) when turn then zs[nseed] else z0 end, case when ok then greatest(z1, zs[nxt]) when turn then zs[nseed] else z1 end,
    coalesce(turn and nseed is null, false)
  from (select *, not ok and down turn, case when not ok and down then list_filter(seeds, lambda s: not list_contains(used, s))[1] end nseed
    from (select *, coalesce(greatest(z1, zs[nxt])-least(z0, zs[nxt])+1<=span
        and sqrt((xs[nxt]-sx/n)*(xs[nxt]-sx/n)+(ys[nxt]-sy/n)*(ys[nxt]-sy/n))<=342, false) ok
      from (select w.*, v.* exclude (g, volume_id), list_filter(case when down then ds[head] else us[head] end, lambda c: not list_contains(used, c))[1] nxt
        from lwalk w join lvol v on w.g=v.g and w.volume_id=v.volume_id where not done)))),
lmem as (select g, volume_id, unnest(used) p, unnest(own) sp from lwalk where done),
tubes as (select r.g, r.volume_id, t.det_id tube_id, r.det_id, r.slice_z, r.x1, r.y1, r.x2, r.y2, r.score
  from (select lmem.* from lmem join lpar using (g) qualify count(*) over (partition by g, volume_id, sp)>=any_value(len) over (partition by g)) m
  join lr r on r.g=m.g and r.volume_id=m.volume_id and r.p=m.p join lr t on t.g=m.g and t.volume_id=m.volume_id and t.p=m.sp),
"""
# pool, recall and CPM of every group g of linked detections
POOLED_L = f"""
lg as (select distinct g from ldet),
lh as (select g, volume_id public_id, tube_id, max(score) score_max, {RE('min(y1)')} min_d0, {RE('min(x1)')} min_d1, min(slice_z) min_d2,
  {RE('max(y2)')}-1 max_d0, {RE('max(x2)')}-1 max_d1, max(slice_z) max_d2 from tubes group by 1, 2, 3),
lsc as (select b.*, least(b.score_max, 0.999999::double) probability, coalesce({iou3('b', 'q')}, 0) iou_gt, q.label_id
  from {native('lh', 'g, public_id, tube_id, score_max')} b left join gt_boxes q using (public_id)
  qualify row_number() over (partition by b.g, b.tube_id order by iou_gt desc, q.label_id)=1),
"""
FINAL_L = "lfin as (select * from lsc),"
SWEPT = f"""
lcnt as (select k.g, t.p_thresh, count(distinct case when s.iou_gt>0.3 then s.public_id*1000+s.label_id end) tp, count(case when s.iou_gt<=0.3 then 1 end) fp
  from lg k cross join thr t left join lfin s on s.g=k.g and s.probability>=t.p_thresh group by 1, 2),
lcurve as (select g, p_thresh, (fp+1e-8)/(n_vol+1e-8) fp, (tp+1e-8)/(n_gt+1e-8) recall from lcnt cross join sizes),
lkr as ({at_keys('lcurve', 'g')}),
lrec as (select g, avg(h) recall, sum(h)::bigint n_hit, count(*) n_vol, avg(n) pool_mean, quantile_cont(n::double, 0.5) pool_median, max(n) pool_max, sum(n)::bigint pool_total from (
  select k.g, v.volume_id, count(s.tube_id) n, coalesce(max((s.iou_gt>0.3)::int), 0) h
  from lg k cross join vols v left join lfin s on s.g=k.g and s.public_id=v.volume_id group by 1, 2) group by 1),
lsum as (select r.*, (select avg(x.recall) from lkr x where x.g=r.g) cpm, (select max(c.recall) from lcurve c where c.g=r.g) ceiling from lrec r),
"""
THRESHOLDS = ", ".join(f"{t}::double" for t in C.SCORE_THRESHOLDS)
add("g1", "select * exclude (g) from tubes", B4 + " score", "ldet as (select 0 g, * from det where score>=0.02)," + PAR + LINKED)
SQL["g1_large"] = SQL["g1"]
FP16 = f"""
d16 as (select public_id, cand_seq, label, cen_d0, cen_d1, cen_d2, {ANISO} a from record where label in ('pos', 'neg')),
near16 as (select a.label, a.public_id, a.cand_seq x, b.cand_seq y from d16 a join d16 b on a.label=b.label and a.public_id=b.public_id and {DIST}<=10),
reach16 as (select label, public_id, x, y from near16 union select r.label, r.public_id, r.x, n.y from reach16 r
  join near16 n on n.label=r.label and n.public_id=r.public_id and n.x=r.y),
m16 as (select 'anisotropy' m, label, a v from d16 where a is not null
  union all select 'nn_dist', a.label, min({DIST}) from d16 a join d16 b on a.label=b.label and a.cand_seq<>b.cand_seq group by a.label, a.cand_seq
  union all select 'clusters_per_vol', label, count(distinct c) from (select label, public_id, y, min(x) c from reach16 group by 1, 2, 3) group by label, public_id),
one16 as (select """ + ", ".join(
    f"(select quantile_cont(v, {q}) from m16 where m='{m}' and label='{lab}') {short}_{m}_{n}"
    for m in ("anisotropy", "nn_dist", "clusters_per_vol") for lab, short in (("neg", "fp"), ("pos", "tp"))
    for q, n in ((0.5, "median"), (0.25, "q1"), (0.75, "q3"))) + """,
  (select count(*) from d16 where label='neg') fp_n, (select count(*) from d16 where label='pos') tp_n,
""" + ", ".join(CLIFF(f"(select * from m16 where m='{m}')", "label='neg'", "label='pos'") + f" {m}_delta" for m in ("anisotropy", "nn_dist")) + """),
flag16 as (select *, fp_anisotropy_median>tp_anisotropy_median more_elongated, fp_nn_dist_median<tp_nn_dist_median tighter_nn,
  fp_clusters_per_vol_median>1 multi_cluster_per_vol from one16),
"""
add("a16", """select *, tighter_nn and multi_cluster_per_vol more_clustered, more_elongated and tighter_nn and multi_cluster_per_vol structure_present,
  case when more_elongated and tighter_nn and multi_cluster_per_vol then 'relational' else 'set-level contextual calibration' end claim_scope from flag16""",
    " ".join(f"{s}_{m}_{n}" for m in ("anisotropy", "nn_dist", "clusters_per_vol") for s in ("fp", "tp") for n in ("median", "q1", "q3"))
    + " anisotropy_delta nn_dist_delta", FP16)
add("g2", "select det_id from keep", "", greedy("det", "volume_id, slice_z", "score desc, det_id", "det_id", B4,
    f"({INT2})/((r.x2-r.x1)*(r.y2-r.y1))>=cast(0.8 as double)"))
IOU3N = "*".join(f"greatest(0.0::double, least(k.{c}+k.{e}/2,r.{c}+r.{e}/2)-greatest(k.{c}-k.{e}/2,r.{c}-r.{e}/2))" for c, e in AX)
add("g3", "select pred_id cand_seq from keep", "", greedy("pred", "public_id", "probability desc, pred_id", "pred_id", B6,
    f"({IOU3N})/(k.x_length*k.y_length*k.z_length+r.x_length*r.y_length*r.z_length-{IOU3N}+1e-12)>=cast(0.3 as double)"))
D3 = "sqrt((k.cen_d0-r.cen_d0)*(k.cen_d0-r.cen_d0)+(k.cen_d1-r.cen_d1)*(k.cen_d1-r.cen_d1)+(k.cen_d2-r.cen_d2)*(k.cen_d2-r.cen_d2))"
add("g4", "select cand_seq from keep", "", greedy("record", "public_id", "slice_count desc, cand_seq", "cand_seq", "cen_d0 cen_d1 cen_d2", f"{D3}<=8"))
add("g5", "select public_id, cand_seq, cluster from lab", "", clusters(6.0))
SQL["g5_large"] = SQL["g5"]
add("g6", "select det_id, is_tp from tp", "", TP)
add("g7", "select det_id from keep", "", greedy("det", "volume_id, slice_z", "score desc, det_id", "det_id", B4, f"{iou2('k', 'r')}>cast(0.3 as double)"))
add("g8", f"""select volume_id, slice_z, min(r0) r0, min(c0) c0, max(r1) r1, max(c1) c1,
  row_number() over (partition by volume_id, slice_z order by min(r0), min(c0))-1 component_id, sum((r1-r0+1)*(c1-c0+1))::bigint area
  from (select s.*, case when exists(select 1 from gt_slices a join gt_slices b using (volume_id, slice_z)
      where a.volume_id=s.volume_id and a.slice_z=s.slice_z and a.component_id=0 and b.component_id=1 and {GAP}<=8) then 0 else component_id end lesion
    from gt_slices s) group by volume_id, slice_z, lesion""")
add("g9", "select volume_id, n_voxels from comp", "", COMP)
add("g10", """select v.volume_id, v.d2, count(*) n, """ + ", ".join(f"{f}({t}) {n}_d{i}" for i, t in enumerate(("t0", "t1")) for n, f in (("min", "min"), ("max", "max"), ("sum", "sum"))).replace("sum(t0)", "sum(t0)::bigint").replace("sum(t1)", "sum(t1)::bigint") +
    """ from voxels v join (select t0, cast(floor((t0+0.5::double)*400/200) as bigint) s0 from range(200) t(t0)) a on a.s0=v.d0
  join (select t1, cast(floor((t1+0.5::double)*640/320) as bigint) s1 from range(320) t(t1)) b on b.s1=v.d1 group by 1, 2""")
# ---------------------------------------------------------------- I
add("e1", "select * from curve", "p_thresh fp recall", PAIRS + CURVE)
add("e2", "select (select avg(recall) from kr) cpm, (select max(recall) from curve) ceiling, (select max(fp) from curve) fp_at_ceiling, " + ", ".join(
    f"(select recall from kr where key_fp={k}) r{i}" for i, k in enumerate((0.125, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0))),
    "cpm ceiling fp_at_ceiling r0 r1 r2 r3 r4 r5 r6", PAIRS + CURVE + f"kr as ({at_keys('curve')}),")
def bootstrap(n: int, src: str, s: str) -> str:
    """Replicates of the CPM per group ``s`` of the best-match table ``src``: relation bkr(s, b, key_fp, recall)."""
    return f"""
grp as ({s}),
vidx as (select public_id, row_number() over (order by public_id)-1 i from allvol),
draw as (select b, cast('0x'||substr(md5('0:'||b||':'||j), 1, 15) as bigint)%(select count(*) from allvol) i
  from range({n}) x(b) cross join (select i j from vidx)),
wgt as (select d.b, v.public_id, count(*) w from draw d join vidx v using (i) group by 1, 2),
vcnt as (select b.s, b.public_id, t.p_thresh, count(distinct case when b.max_iou>0.3 then b.hit_label end) tp,
  count(case when b.max_iou<=0.3 then 1 end) fp from thr t join {src} b on b.probability>=t.p_thresh group by 1, 2, 3),
bsz as (select w.b, sum(w.w) n_vol, sum(w.w*g.n) n_gt from wgt w join (select public_id, count(*) n from gt_boxes group by 1) g using (public_id) group by 1),
bcnt as (select c.s, w.b, c.p_thresh, sum(w.w*c.tp) tp, sum(w.w*c.fp) fp from wgt w join vcnt c using (public_id) group by 1, 2, 3),
bcurve as (select g.s, z.b, t.p_thresh, (coalesce(c.fp,0)+1e-8)/(z.n_vol+1e-8) fp, (coalesce(c.tp,0)+1e-8)/(z.n_gt+1e-8) recall
  from grp g cross join bsz z cross join thr t left join bcnt c on c.s=g.s and c.b=z.b and c.p_thresh=t.p_thresh),
bkr as (select s, b, key_fp, case when lo is null then 0.0::double when hi is null then top else lo.r+(hi.r-lo.r)*((key_fp-lo.f)/(hi.f-lo.f+1e-8)) end recall
  from (select c.s, c.b, k.key_fp, max(case when c.fp<=k.key_fp then {{'f': c.fp, 'p': c.p_thresh, 'r': c.recall}} end) lo,
        min(case when c.fp>=k.key_fp then {{'f': c.fp, 'p': c.p_thresh, 'r': c.recall}} end) hi, max(c.recall) top
        from bcurve c cross join keyfp k group by 1, 2, 3)),
bcpm as (select s, b, avg(recall) cpm from bkr group by 1, 2),
"""


add("e3", """select (select avg(recall) from kr) point, quantile_cont(cpm, 0.025) lo, quantile_cont(cpm, 0.975) hi from bcpm""", "point lo hi",
    PAIRS + CURVE + f"kr as ({at_keys('curve')}), pb1 as (select *, 'all' s from pbest)," + bootstrap(1000, "pb1", "select 'all' s"))
FLOORS = "[0.0,0.03,0.05,0.07,0.1,0.15,0.2,0.3,0.5]"
add("e7", f"""select f "floor", avg((t>0)::int) recall, sum(k)::bigint kept_total, sum(k)/count(*)::double pool_mean, max(k) pool_max, sum(t)::bigint n_tp_kept from (
  select f, v.public_id, count(s.pred_id) k, count(*) filter (s.iou_gt>0.3) t from (select unnest({FLOORS})::double f) x cross join allvol v
  left join scored s on s.public_id=v.public_id and s.score_max>=f group by 1, 2) group by f""", '"floor" recall pool_mean', PAIRS)
add("e9", f"""select g.volume_id, count(*) filter (iou>=0.1) n_cov_slices, coalesce(max(iou), 0) best_2d_iou, count(*) n_gt_slices from (
  select g.volume_id, g.slice_z, max({iou2('g', 'd')}) iou from gt2 g left join det d using (volume_id, slice_z) group by 1, 2) g group by 1""", "best_2d_iou")
LADDER = """
sbest as (select *, 'full_seed'||(pred_id%3) s from pbest),
scnt as (select n.s, t.p_thresh, count(distinct case when b.max_iou>0.3 then b.public_id*1000+b.hit_label end) tp, count(case when b.max_iou<=0.3 then 1 end) fp
  from (select 'full_seed'||i s from range(3) r(i)) n cross join thr t left join sbest b on b.s=n.s and b.probability>=t.p_thresh group by 1, 2),
scurve as (select s, p_thresh, (fp+1e-8)/(n_vol+1e-8) fp, (tp+1e-8)/(n_gt+1e-8) recall from scnt cross join sizes),
"""
LADDER += f"skr as ({at_keys('scurve', 's')}),\nladder as (select s detector_of_origin, avg(recall) cpm, (select max(recall) from scurve c where c.s=skr.s) ceiling from skr group by s),"
add("e13", """select l.*, q.lo, q.hi from ladder l join (select s, quantile_cont(cpm, 0.025) lo, quantile_cont(cpm, 0.975) hi from bcpm group by 1) q
  on q.s=l.detector_of_origin""", "cpm ceiling lo hi", PAIRS + CURVE + LADDER + bootstrap(1000, "sbest", "select distinct s from scnt"))
add("e13_seeds", "select 'all' k, avg(cpm) cpm_mean, stddev_pop(cpm) cpm_std, avg(ceiling) ceiling_mean, stddev_pop(ceiling) ceiling_std from ladder",
    "cpm_mean cpm_std ceiling_mean ceiling_std", PAIRS + CURVE + LADDER)
add("e16", """select * from brk2
  union all select 'volume', 'hit', count(*), count(*) filter (hit_slices>0), avg((hit_slices>0)::int) from hits
  union all select 'volume', 'middle_hit_slices', (select count(*) from hits), (select hit_slices from hits order by hit_slices limit 1 offset (select count(*)//2 from hits)), null
  union all select 'volume', 'missed', (select count(distinct volume_id) from gt_slices), (select count(*) from missed), null""", "recall", BUCKETS + MATCH + BREAK + HITS)
add("e19", """select name, value, pinned_value, abs(value-pinned_value) diff, abs(value-pinned_value)<=5 ok from (
  select 'max_tube_zspan' as name, max_tube_zspan::double as value, (select max(slice_z)*2 from gt_slices)::double pinned_value from caps
  union all select 'max_centroid_drift', max_centroid_drift::double, (select max(c1-c0) from gt_slices)::double from caps)""",
    "value pinned_value diff", CAPS)
add("e11", """select g epoch, cpm, ceiling, recall, pool_mean, g=(select e.g from lsum e where e.g>=1
    and e.cpm>=(select max(cpm) from lsum where g>=1)-0.02 order by e.ceiling desc, e.g limit 1) selected from lsum""", "cpm ceiling recall pool_mean",
    PAIRS + CURVE + """
ldet as (select * from (select x.g, d.* replace (case when (d.det_id+x.g)%5=0 then d.score*0.25::double else d.score end as score)
  from det d cross join range(5) x(g)) where score>=0.02),""" + PAR + LINKED + POOLED_L + FINAL_L + SWEPT)
add("e12", """select *, coalesce(thresh=(select thresh from agg where recall_mean>=0.98::double*(select max(recall_mean) from agg)-1e-12
    order by cpm_mean desc, pool_mean_mean, thresh limit 1), false) chosen,
  coalesce(recall_mean<lag(recall_mean) over (order by thresh desc)-1e-9, false) recall_dropped from agg""",
    "recall_mean recall_std cpm_mean cpm_std ceiling_mean ceiling_std pool_mean_mean pool_mean_std", PAIRS + CURVE + f"""
ldet as (select * from (select x.g*100+t.i g, d.* replace (d.score*(1::double-0.125::double*x.g) as score), t.v from det d cross join range(3) x(g)
  cross join (select unnest(range({len(C.SCORE_THRESHOLDS)})) i, unnest([{THRESHOLDS}]) v) t) where score>=v),""" + PAR + LINKED + POOLED_L + FINAL_L + SWEPT + f"""
agg as (select [{THRESHOLDS}][g%100+1] thresh, """ + ", ".join(f"avg({c}) {c}_mean, stddev_pop({c}) {c}_std" for c in ("recall", "cpm", "ceiling", "pool_mean"))
    + " from lsum group by 1),")
add("e18", f"""select [{THRESHOLDS}][g+1] thresh, recall, n_hit, n_vol, pool_mean, pool_max, cpm, ceiling,
  thresh=(select max([{THRESHOLDS}][g+1]) from lsum where recall>=0.98::double*(select max(recall) from lsum)) is_knee from lsum""",
    "thresh recall pool_mean cpm ceiling", PAIRS + CURVE + f"""
ldet as (select t.i g, d.* from det d join (select unnest(range({len(C.SCORE_THRESHOLDS)})) i, unnest([{THRESHOLDS}]) v) t on d.score>=t.v),""" + PAR + LINKED + POOLED_L + FINAL_L + SWEPT)
# the base and one change each: (label, IoU, length, span); the rest differ in their detections or their pool
KNOBS = [("base", 0.3, 3, 182), ("link_iou=0.2", 0.2, 3, 182), ("link_iou=0.4", 0.4, 3, 182), ("min_tube_len=2", 0.3, 2, 182),
         ("containment=0.8", 0.3, 3, 182), ("nms_iou=0.3", 0.3, 3, 182), ("score_floor=0.3", 0.3, 3, 182), ("max_tube_zspan=4", 0.3, 3, 4)]
add("e4", "select g config_id, config, recall, n_hit, n_vol, pool_mean, pool_median, pool_max, pool_total from lsum join lpar using (g)",
    "recall pool_mean pool_median", PAIRS + CURVE + greedy("det", "volume_id, slice_z", "score desc, det_id", "det_id", B4,
        f"coalesce({inter2('k', 'r')}/nullif((r.x2-r.x1)*(r.y2-r.y1), 0), 0)>=0.8") + "lpar as (select * from (values " + ", ".join(
        f"({i}, '{n}', {t}::double, {m}, {z})" for i, (n, t, m, z) in enumerate(KNOBS)) + """) v(g, config, iou, len, span)),
ldet as (select lpar.g, d.* from det d cross join lpar where d.score>=0.02 and (lpar.config<>'containment=0.8' or d.det_id in (select det_id from keep))),
""" + LINKED + POOLED_L + greedy("(select * from lsc where g=5)", "public_id", "score_max desc, tube_id", "tube_id", B6,
        f"({IOU3N})/(k.x_length*k.y_length*k.z_length+r.x_length*r.y_length*r.z_length-{IOU3N}+1e-12)>=cast(0.3 as double)")
    .replace("ranked", "ranked_n").replace("walk", "walk_n").replace("last", "last_n").replace("keep as", "keep_n as") + """
lfin as (select * from lsc where (g<>5 or tube_id in (select tube_id from keep_n)) and (g<>6 or score_max>=0.3)),
""" + SWEPT)
# the distributed forms have to give the same rows
for _k in ("g2", "g3", "g4", "g7", "w1"):
    SQL[f"{_k}_large"] = SQL[_k]
