"""Value and frequency scales, pixels, viewports, labels and ticks."""

from __future__ import annotations

from pyspark.sql import functions as F

from chirpline.config import ValueScale
from chirpline.functions import axis
from chirpline.functions import scales as s
from chirpline.queries.registry import query, r, table

_LABEL_STEPS = [0.01, 0.5, 1.0, 60.0]


def _mag():
    """Magnitudes between 0 and 0.1."""
    return F.col("l_discount") * F.col("l_quantity") / 50


_LINE = "l_orderkey, l_linenumber"
_MAG = "(l_discount * l_quantity / 50)"
_DB = f"(20 * log10(greatest(1e-12, abs({_MAG}))))"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_orderkey is not null")


@query(f"select {_LINE}, l_partkey, round({_DB}, 6) as db, round(pow(10, {_DB} / 20), 6) as mag, round(pow(pow(10, {_DB} / 20), 2), 6) as power from lineitem")
def db_roundtrip(spark, sf_dir):
    db = s.db_of(_mag())
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", r(db).alias("db"), r(s.magnitude_of(db)).alias("mag"), r(s.power_of(db)).alias("power"))


@query(f"select {_LINE}, l_partkey, round(least(1, greatest(0, ({_DB} + 80) / 70)), 6) as norm from lineitem")
def normalize_db(spark, sf_dir):
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", r(s.normalized(s.db_of(_mag()), ValueScale("db", -80, -10))).alias("norm"))


@query(f"select {_LINE}, l_partkey, round(pow(least(1, greatest(0, ({_MAG} - pow(10, -60 / 20.0)) / (pow(10, -20 / 20.0) - pow(10, -60 / 20.0)))), 0.5), 6) as norm from lineitem")
def normalize_magnitude(spark, sf_dir):
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", r(s.normalized(_mag(), ValueScale("magnitude", -60, -20, 0.5))).alias("norm"))


@query(f"select {_LINE}, l_partkey, round(greatest(0, ({_MAG} * {_MAG} - pow(pow(10, -60 / 20.0), 2)) / (pow(pow(10, -30 / 20.0), 2) - pow(pow(10, -60 / 20.0), 2))), 6) as norm from lineitem")
def normalize_power(spark, sf_dir):
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", r(s.normalized(s.in_mode(_mag(), "power"), ValueScale("power", -60, -30, clamp=False))).alias("norm"))


@query(f"select {_LINE}, l_partkey, least(255, greatest(0, floor(least(1, greatest(0, ({_DB} + 100) / 100)) * 255 + 0.5)))::int as level from lineitem")
def quantize_u8(spark, sf_dir):
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", s.as_byte(s.normalized(s.db_of(_mag()), ValueScale())).alias("level"))


@query("select p_partkey, round(2595 * log10(1 + p_retailprice / 700), 6) as mel, round(700 * (pow(10, (2595 * log10(1 + p_retailprice / 700)) / 2595) - 1), 6) as hz from part")
def hz_mel_roundtrip(spark, sf_dir):
    mel = s.to_scale(F.col("p_retailprice"), "mel")
    return table(spark, sf_dir, "part").select("p_partkey", r(mel).alias("mel"), r(s.from_scale(mel, "mel")).alias("hz"))


@query("select p_partkey, round(log10(greatest(1, p_retailprice - 1000)), 6) as lg, round(pow(10, log10(greatest(1, p_retailprice - 1000))), 6) as hz from part")
def hz_scale_log(spark, sf_dir):
    lg = s.to_scale(F.col("p_retailprice") - 1000, "log")
    return table(spark, sf_dir, "part").select("p_partkey", r(lg).alias("lg"), r(s.from_scale(lg, "log")).alias("hz"))


@query(
    """with p as (select c_custkey, (c_custkey % 800)::double as x, (c_custkey % 301)::double as y from customer)
select c_custkey, round(10 + x / 800 * 30, 6) as t, round(8000 - y / 300 * 7900, 6) as linear,
  round(700 * (pow(10, (2595 * log10(1 + 8000 / 700.0) - y / 300 * (2595 * log10(1 + 8000 / 700.0) - 2595 * log10(1 + 100 / 700.0))) / 2595) - 1), 5) as mel,
  round(pow(10, log10(8000) - y / 300 * (log10(8000) - log10(100))), 5) as log from p"""
)
def canvas_to_tf(spark, sf_dir):
    x, y = (F.col("c_custkey") % 800).cast("double"), (F.col("c_custkey") % 301).cast("double")
    hz = lambda scale: s.hz_at(y, F.lit(300), F.lit(100.0), F.lit(8000.0), scale)
    t = s.time_at(x, F.lit(800), F.lit(10.0), F.lit(40.0))
    return table(spark, sf_dir, "customer").select("c_custkey", r(t).alias("t"), r(hz("linear")).alias("linear"), r(hz("mel"), 5).alias("mel"), r(hz("log"), 5).alias("log"))


@query(
    """with p as (select c_custkey, c_acctbal / 100 as t, abs(c_acctbal) as f from customer)
select c_custkey, round((t - 10) / 30 * 800, 6) as x, round((1 - (f - 100) / 7900) * 300, 6) as linear,
  round((1 - (2595 * log10(1 + f / 700) - 2595 * log10(1 + 100 / 700.0)) / (2595 * log10(1 + 8000 / 700.0) - 2595 * log10(1 + 100 / 700.0))) * 300, 6) as mel,
  round((1 - (log10(greatest(1, f)) - 2) / (log10(8000) - 2)) * 300, 6) as log from p"""
)
def tf_to_canvas(spark, sf_dir):
    t, f = F.col("c_acctbal") / 100, F.abs("c_acctbal")
    y = lambda scale: s.y_at(f, F.lit(300), F.lit(100.0), F.lit(8000.0), scale)
    return table(spark, sf_dir, "customer").select("c_custkey", r(s.x_at(t, F.lit(800), F.lit(10.0), F.lit(40.0))).alias("x"), r(y("linear")).alias("linear"), r(y("mel")).alias("mel"), r(y("log")).alias("log"))


_VIEW = "(o_orderkey % 1000)::double as a, (o_orderkey % 1000 + 10 + o_custkey % 300)::double as b"


def _views(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 1000).cast("double").alias("a"), (F.col("o_orderkey") % 1000 + 10 + F.col("o_custkey") % 300).cast("double").alias("b"))


@query(
    f"""with v as (select o_orderkey, o_totalprice / 1000 - 150 as d, {_VIEW} from orders), m as (select o_orderkey, a, b, least(greatest(a + d, 50), greatest(50, 900 - (b - a))) as low from v)
select o_orderkey, round(low, 6) as low, round(low + (b - a), 6) as high from m"""
)
def pan_range(spark, sf_dir):
    low, high = s.panned(F.col("a"), F.col("b"), F.lit(50.0), F.lit(900.0), F.col("o_totalprice") / 1000 - 150)
    return _views(spark, sf_dir).select("o_orderkey", r(low).alias("low"), r(high).alias("high"))


@query(
    f"""with v as (select o_orderkey, o_totalprice % 500 as c, o_totalprice / 100000 as f, {_VIEW} from orders),
p as (select *, least(greatest((b - a) * f, 5), 200) as span, (c - a) / (b - a) as ratio from v),
q as (select *, least(greatest(c - span * ratio, 0), greatest(0, 1000 - span)) as low from p)
select o_orderkey, round(case when abs(span - (b - a)) < 1e-9 then a else low end, 7) as low, round(case when abs(span - (b - a)) < 1e-9 then b else low + span end, 7) as high from q"""
)
def zoom_range(spark, sf_dir):
    low, high = s.zoomed(F.col("a"), F.col("b"), F.lit(0.0), F.lit(1000.0), F.col("o_totalprice") % 500, F.col("o_totalprice") / 100000, F.lit(5.0), F.lit(200.0))
    return _views(spark, sf_dir).select("o_orderkey", r(low, 7).alias("low"), r(high, 7).alias("high"))


@query(f"with v as (select o_orderkey, {_VIEW} from orders), m as (select o_orderkey, least(b - a, 600) as span, a from v) select o_orderkey, least(greatest(a, 100), 700 - span) as low, least(greatest(a, 100), 700 - span) + span as high from m")
def clamp_viewport(spark, sf_dir):
    low, high = s.moved_inside(F.col("a"), F.col("b"), F.lit(100.0), F.lit(700.0))
    return _views(spark, sf_dir).select("o_orderkey", low.alias("low"), high.alias("high"))


@query(f"with v as (select o_orderkey, o_totalprice / 500 as t, {_VIEW} from orders) select o_orderkey, case when t >= a and t <= b then round((t - a) / (b - a) * 800, 6) end as x from v")
def playhead(spark, sf_dir):
    return _views(spark, sf_dir).select("o_orderkey", r(s.playhead_x(F.col("o_totalprice") / 500, F.lit(800), F.col("a"), F.col("b"))).alias("x"))


def _time_label_sql(style: str) -> str:
    a = "abs(t)"
    if style == "timecode":
        body = f"concat(printf('%02d:%02d:%02d', floor({a} / 3600)::int, floor({a} % 3600 / 60)::int, floor({a} % 60)::int), case when step < 1 then printf('.%03d', floor(({a} % 1) * 1000)::int) else '' end)"
    else:
        dec = lambda lo, hi, other: f"case when step < 1 then least({hi}, greatest({lo}, ceil(-log10(step)))) else {other} end"
        fixed = lambda d, v=a: f"(case ({d})::int when 0 then printf('%.0f', {v}) when 1 then printf('%.1f', {v}) when 2 then printf('%.2f', {v}) when 3 then printf('%.3f', {v}) else printf('%.4f', {v}) end)"
        body = f"""case when {a} < 1 then concat({fixed(dec(1, 4, 2))}, 's') when {a} < 60 then concat({fixed(dec(0, 3, 0))}, 's')
          when {a} < 3600 then concat(printf('%d:%02d', floor({a} / 60)::int, floor({a} % 60)::int), case when step < 1 then substring({fixed('least(3, ceil(-log10(step)))', f'({a} % 1)')}, 2, 9) else '' end)
          else printf('%d:%02d:%02d', floor({a} / 3600)::int, floor({a} % 3600 / 60)::int, floor({a} % 60)::int) end"""
    return f"with v as (select c_custkey, c_acctbal * 1.37 as t, ([0.01, 0.5, 1.0, 60.0])[c_custkey % 4 + 1]::double as step from customer) select c_custkey, concat(case when t < 0 then '-' else '' end, {body}) as label from v"


def _labels(spark, sf_dir, style):
    step = F.get(F.array(*map(F.lit, _LABEL_STEPS)), (F.col("c_custkey") % 4).cast("int"))
    # SQL's concat leaves nulls out
    label = F.coalesce(axis.time_label(F.col("c_acctbal") * 1.37, step, style), F.lit(""))
    return table(spark, sf_dir, "customer").select("c_custkey", label.alias("label"))


@query(_time_label_sql("timecode"))
def time_label_timecode(spark, sf_dir):
    return _labels(spark, sf_dir, "timecode")


@query(_time_label_sql("auto"))
def time_label_auto(spark, sf_dir):
    return _labels(spark, sf_dir, "auto")


@query(
    """with p as (select p_partkey, p_retailprice * (1 + p_partkey % 20) as f from part), q as (select p_partkey, case when p_partkey % 5 = 0 then floor(f / 1000) * 1000 else f end as f from p)
select p_partkey, case when f < 1000 then concat(floor(f + 0.5)::bigint, ' Hz') when f / 1000 % 1 = 0 then concat((f / 1000)::bigint, ' kHz') else concat(printf('%.1f', f / 1000), ' kHz') end as label from q"""
)
def freq_label_auto(spark, sf_dir):
    f = F.col("p_retailprice") * (1 + F.col("p_partkey") % 20)
    f = F.when(F.col("p_partkey") % 5 == 0, F.floor(f / 1000).cast("double") * 1000).otherwise(f)
    return table(spark, sf_dir, "part").select("p_partkey", axis.frequency_label(f).alias("label"))


_STEPS_SQL = "[" + ", ".join(str(float(x)) for x in axis.TIME_STEPS) + "]::double[]"


@query(
    f"""with v as (select o_orderkey, (o_orderkey % 500)::double as a, (o_orderkey % 500)::double + 1 + o_custkey % 97 * 13.0 as b, (300 + o_custkey % 700)::double as w from orders),
q as (select *, greatest(1e-6, b - a) / greatest(1, floor(w / 75)) as raw from v), s as (select *, coalesce(list_filter({_STEPS_SQL}, lambda x: x >= raw)[1], 86400.0) as step from q)
select o_orderkey, step, round(k * step, 10) as tick from s, unnest(range(floor((a - 1e-9) / step)::bigint, ceil((b + 1e-9) / step)::bigint + 1)) u(k) where k * step >= a - 1e-9 and k * step <= b + 1e-9"""
)
def time_ticks(spark, sf_dir):
    a = (F.col("o_orderkey") % 500).cast("double")
    b = a + 1 + F.col("o_custkey") % 97 * 13.0
    views = table(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), b.alias("b"), (300 + F.col("o_custkey") % 700).alias("w"))
    stepped = views.withColumn("step", axis.time_step(F.col("a"), F.col("b"), F.col("w")))
    return stepped.select("o_orderkey", "step", F.explode(axis.ticks_between(F.col("a"), F.col("b"), F.col("step"))).alias("tick"))


@query(
    f"""with v as (select o_orderkey, (o_orderkey % 500)::double as a, (o_orderkey % 500)::double + (1 + o_custkey % 97 * 13.0) * case o_orderkey % 4 when 0 then 0.01 when 1 then 1 when 2 then 7 else 60 end as b, (300 + o_custkey % 700)::double as w from orders),
q as (select *, greatest(1e-6, b - a) / greatest(1, floor(w / 75)) as raw from v), s as (select *, coalesce(list_filter({_STEPS_SQL}, lambda x: x >= raw)[1], 86400.0) as step from q),
p as (select *, case when step in (1800, 3600) then 6 when step in (0.001, 0.002, 0.02, 0.2, 2, 20, 7200) and step <> 0.001 then case when step = 7200 then 5 else 4 end else 5 end as parts from s)
select o_orderkey, parts, round(k * (step / parts), 9) as tick from p, unnest(range(floor((a - 1e-9) / (step / parts))::bigint, ceil((b + 1e-9) / (step / parts))::bigint + 1)) u(k) where k * (step / parts) >= a - 1e-9 and k * (step / parts) <= b + 1e-9"""
)
def minor_ticks(spark, sf_dir):
    """Minor ticks of time axes of a hundredth of a second to a day."""
    key = F.col("o_orderkey")
    a = (key % 500).cast("double")
    b = a + (1 + F.col("o_custkey") % 97 * 13.0) * F.element_at(F.array(F.lit(0.01), F.lit(1.0), F.lit(7.0), F.lit(60.0)), (key % 4 + 1).cast("int"))
    views = table(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), b.alias("b"), (300 + F.col("o_custkey") % 700).alias("w"))
    stepped = views.withColumn("step", axis.time_step(F.col("a"), F.col("b"), F.col("w"))).withColumn("parts", axis.minor_parts(F.col("step")))
    return stepped.select("o_orderkey", "parts", F.explode(axis.ticks_between(F.col("a"), F.col("b"), F.col("step") / F.col("parts"))).alias("tick")).withColumn("tick", r("tick", 9))


_AXES = """v as (select p_partkey, (p_partkey % 7 * 50)::double as low, p_partkey % 7 * 50 + p_retailprice::double * (1 + p_partkey % 20) as high, (100 + p_partkey % 900)::double as height from part)"""
_DECADES = "t as (select (m * pow(10, e))::double as f, m from range(1, 10) a(m), range(1, 5) b(e))"


def _greedy(least: float) -> str:
    """k(p_partkey, f): candidates c(p_partkey, f, y), each far enough from the last."""
    return f"""k as (select p_partkey, f, y from c where (p_partkey, f) in (select p_partkey, min(f) from c group by 1)
  union all select p_partkey, f, y from (select c.p_partkey, c.f, c.y, row_number() over (partition by c.p_partkey order by c.f) as i from k join c on c.p_partkey = k.p_partkey and c.f > k.f and abs(c.y - k.y) >= {least}) where i = 1)"""


def _ticks(spark, sf_dir, scale):
    """Ticks of a frequency axis for each part."""
    key = F.col("p_partkey")
    low = (key % 7 * 50).cast("double")
    major, minor = axis.frequency_ticks(low, low + F.col("p_retailprice").cast("double") * (1 + key % 20), 100 + key % 900, scale)
    both = F.flatten(F.array(F.transform(major, lambda f: F.struct(f.alias("hz"), F.lit("major").alias("kind"))), F.transform(minor, lambda f: F.struct(f.alias("hz"), F.lit("minor").alias("kind")))))
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(both))


@query(
    f"""with {_AXES}, s as (select *, list_filter(list_transform(range(0, 15), lambda i: [1, 2, 5][i % 3 + 1] * pow(10, i // 3)), lambda x: x >= (high - low) / greatest(1, floor(height / 45)))[1] as step from v),
k as (select p_partkey, low, high, 'major' as kind, floor(unnest(range(floor(low / step)::bigint, floor((high + 1e-6) / step)::bigint + 1)) * step + 0.5) as hz from s
  union all select p_partkey, low, high, 'minor', floor(unnest(range(floor(low / (step / 5))::bigint, floor((high + 1e-6) / (step / 5))::bigint + 1)) * (step / 5) + 0.5) from s)
select p_partkey, hz::double as hz, kind from k where hz >= low and hz <= high"""
)
def freq_ticks_linear(spark, sf_dir):
    return _ticks(spark, sf_dir, "linear")


@query(
    f"""with recursive {_AXES}, {_DECADES},
c as (select p_partkey, f, (1 - (log10(f) - log10(greatest(1, low))) / (log10(high) - log10(greatest(1, low)))) * height as y from v join t on m in (1, 2, 5) and f <= 20000 and f >= low and f <= high), {_greedy(45 * 0.75)}
select p_partkey, f as hz, 'major' as kind from k
union all select p_partkey, f, 'minor' from v join t on f >= low and f <= high where (p_partkey, f) not in (select p_partkey, f from k)"""
)
def freq_ticks_log(spark, sf_dir):
    return _ticks(spark, sf_dir, "log")


@query(
    f"""with recursive {_AXES},
c as (select p_partkey, f, (1 - (log10(1 + f / 700) - log10(1 + low / 700)) / (log10(1 + high / 700) - log10(1 + low / 700))) * height as y from v join (select unnest({axis.MEL_TICKS}::double[]) as f) on f >= low and f <= high), {_greedy(45)}
select p_partkey, f as hz, 'major' as kind from k"""
)
def freq_ticks_mel(spark, sf_dir):
    return _ticks(spark, sf_dir, "mel")
