"""The queries once more, as SQL over the same tables.

Statements are put together from common table expressions. They follow the
definitions, not the DataFrame plans: neighbours are found by joins or list
lookups where the plans use windows, transitions and zooms by recursion.
"""

from __future__ import annotations

from . import params as P

PI = "3.141592653589793e0"


PLACES, QUOTED = ("sx", "sy", "x0", "y0", "ax", "ay", "bx"), '"by"'


def num(x) -> str:
    return f"{float(x)!r}" + ("" if "e" in repr(float(x)) else "e0")


def clamp(v, low="0e0", high="1e0") -> str:
    return f"greatest({low}, least({high}, {v}))"


def mix(a, b, t) -> str:
    return f"({a} + ({b} - {a}) * ({t}))"


def step(a, b, v) -> str:
    t = clamp(f"((({v}) - {a}) / ({b} - {a}))")
    return f"({t} * {t} * (3e0 - 2e0 * {t}))"


def strength(v, c) -> str:
    return step(num(P.FLOOR[c] * 0.45), "0.93e0", v)


def radius(v, spacing, c) -> str:
    return f"({spacing} * {P.OVERLAP[c]}e0 * power({strength(v, c)}, {P.EXPONENT[c]}e0))"


def state(storm="storm", hail="hail") -> str:
    s, h = strength(storm, "storm"), strength(hail, "hail")
    return f"(case when {h} > 0 then 3 + greatest(1, cast(ceil({h} * 3) as integer)) when {s} > 0 then greatest(1, cast(ceil({s} * 3) as integer)) else 0 end)"


def strong(rain) -> str:
    return clamp(f"(({rain} - 0.55e0) / (1e0 - 0.55e0))")


def hazard_radius(storm, hail, s, spacing) -> str:
    a, b = (mix(low, high, f"power({strength(v, c)}, 0.47e0)") for v, c, low, high in ((storm, "storm", "0.3e0", "0.72e0"), (hail, "hail", "0.34e0", "1e0")))
    return f"(case when {s} <= 0 then 0e0 when {s} <= 3 then {spacing} * {a} else {spacing} * {b} end)"


def r6(c, name=None) -> str:
    return f"round({c}, {9 if (name or c) in (*PLACES, QUOTED) else 6}) + 0e0 as {name or c}"


def field(src: str, out: str, x="x", y="y") -> str:
    """out: src with rain, storm and hail."""
    run = lambda v: mix(num(v[0]), num(v[1]), f"w{v[2]}") if isinstance(v, tuple) else num(v)
    sums = {c: [] for c in P.CHANNELS}
    for c, sign, dx, cy, sx, sy, rot, amp in P.COMPONENTS:
        ax, ay, co, si = f"({x} - (travel_x + {num(dx)}))", f"({y} - {num(cy)})", f"cos({run(rot)})", f"sin({run(rot)})"
        rx, ry = f"({ax} * {co} + {ay} * {si})", f"({ay} * {co} - {ax} * {si})"
        sums[c].append(f"{'-' if sign < 0 else ''}exp(-0.5e0 * (({rx} * {rx}) / ({run(sx)} * {run(sx)}) + ({ry} * {ry}) / ({run(sy)} * {run(sy)}))) * {run(amp)}")
    local = f"({x} - travel_x)"
    detail = {
        "rain": f"(0.91e0 + 0.045e0 * sin({local} * 47e0 + sin({y} * 31e0)) + 0.035e0 * sin({y} * 59e0 - {local} * 17e0))",
        "storm": f"(0.96e0 + 0.045e0 * sin({local} * 41e0 + {y} * 33e0))",
        "hail": f"(0.97e0 + 0.035e0 * sin({local} * 53e0 - {y} * 47e0))",
    }
    value = lambda c: f"case when abs({local}) > 0.92e0 or abs({y} - 0.5e0) > 0.76e0 then 0e0 else {clamp(f'(({" + ".join(sums[c])}) * {detail[c]} * life)')} end as {c}"
    waves = ", ".join(f"0.5e0 + 0.5e0 * sin((t + {p}e0) * (2e0 * {PI})) as w{k}" for k, p in P.PHASES.items())
    return f"""{out}_w as (select *, {waves}, {step('0e0', '0.12e0', 't')} * {step('0e0', '0.12e0', '1e0 - t')} as life from {src}),
{out} as (select * exclude (wa, wb, wc, life), {', '.join(map(value, P.CHANNELS))} from {out}_w)"""


POINTS = """points as (select event_id, user_id, event_type, ts, value, (epoch_us(ts) % 86400000000) / 86400000000e0 as t,
  (user_id % 128 + 0.5e0) / 128 as x, (event_id % 128 + 0.5e0) / 128 as y, 0.5e0 as travel_x from events)"""
VALUES = f"{POINTS},\n{field('points', 'v')}"


def viewport(src: str) -> str:
    left, right = "(0.5e0 - center_x / field_pixels)", "(0.5e0 + (width - center_x) / field_pixels)"
    level = f"greatest(0e0, least(5e0, log2(11.5e0 / greatest(field_pixels * zoom / 128, 0.001e0))))"
    return f"""framed as (select *, 0.92e0 * least(width, height) as field_pixels, width / 2e0 as center_x, height / 2e0 - least(24e0, 0.025e0 * height) as center_y from ({src})),
frames as (select *, 0.5e0 - center_x / (field_pixels * zoom) as min_x, 0.5e0 + (width - center_x) / (field_pixels * zoom) as max_x,
  0.5e0 - center_y / (field_pixels * zoom) as min_y, 0.5e0 + (height - center_y) / (field_pixels * zoom) as max_y,
  {mix(mix(left, right, '0.33e0'), mix(left, right, '0.67e0'), step('0e0', '1e0', 't'))} as travel_x, {level} as continuous, cast(floor({level} + 0.5e0) as integer) as lod from framed)"""


REGION = viewport(
    "select cast(r_regionkey as bigint) frame_id, (r_regionkey + 1) / 6e0 t, case when r_regionkey % 2 = 0 then 1280 else 900 end width, "
    "case when r_regionkey % 2 = 0 then 800 else 900 end height, 0.4e0 + r_regionkey * 0.3e0 zoom, cast(r_regionkey % 3 as integer) fine, (r_regionkey + 1) / 7e0 progress from region"
)
CUSTOMER = viewport("select c_custkey frame_id, (c_custkey % 97) / 97e0 t, 600 + c_custkey % 1400 width, 400 + c_custkey % 900 height, 0.1e0 + (c_custkey % 55) * 0.1e0 zoom from customer")


def cells(src: str, out: str, i0, i1, j0, j1, more="") -> str:
    """out: src with every (i, j), both ends included."""
    return f"""{out}_j as (select *, unnest(range(cast({j0} as bigint), cast({j1} as bigint) + 1)) as j from {src}),
{out} as (select *, unnest(range(cast({i0} as bigint), cast({i1} as bigint) + 1)) as i{more} from {out}_j)"""


def grid(extra: int = 0, bounded: bool = False, out: str = "g") -> str:
    """out: frame_id, row, col and channels on the finest grid; gb: frames with its bounds."""
    pad = 7 + extra
    lx, hx, ly, hy = "travel_x - 0.92e0", "travel_x + 0.92e0", "-0.26e0", "1.26e0"
    if bounded:
        lx, hx, ly, hy = f"greatest({lx}, min_x)", f"least({hx}, max_x)", f"greatest({ly}, min_y)", f"least({hy}, max_y)"
    at = lambda fn, v, p: f"cast({fn}(({v}) * 128 - 0.5e0) as bigint) {p}"
    return f"""gb as (select *, {at('floor', lx, f'- {pad}')} start_i, {at('ceil', hx, f'+ {pad}')} end_i, {at('floor', ly, f'- {pad}')} start_j, {at('ceil', hy, f'+ {pad}')} end_j from frames),
{cells('gb', 'gc', 'start_i', 'end_i', 'start_j', 'end_j')},
gp as (select *, (i + 0.5e0) / 128 as x, (j + 0.5e0) / 128 as y from gc),
{field('gp', 'gf')},
{out} as (select frame_id, cast(j - start_j as integer) as row, cast(i - start_i as integer) as col, rain, storm, hail from gf)"""


def f32(v) -> str:
    return f"cast(cast({v} as float) as double)"


def lines(src: str, out: str, across: str, along: str) -> str:
    """out: a row for each line of a grid with its values as lists."""
    return f"{out} as (select frame_id, {across}, count(*) n, {', '.join(f'list({c} order by {along}) {c}' for c in P.CHANNELS)} from {src} group by frame_id, {across})"


def stencil(src: str, out: str, across: str, along: str, value) -> str:
    """out: each cell from its line's list; value(list, k) is the SQL of cell k (from 1), n the line's length."""
    made = ", ".join(f"{f32(value(c, 'k'))} as {c}" for c in P.CHANNELS)
    return f"""{lines(src, out + '_l', across, along)},
{out} as (select frame_id, {across}, cast(k - 1 as integer) as {along}, {made} from (select *, unnest(range(1, n + 1)) k from {out}_l))"""


def gauss(src: str, out: str) -> str:
    w = P.kernel()
    at = lambda c, k, d: f"{c}[greatest(1, least(n, {k} {'-' if d < 0 else '+'} {abs(d)}))]"
    value = lambda c, k: "(" + " + ".join(f"{at(c, k, d)} * {num(w[d + 4])}" for d in range(-4, 5)) + ")"
    return f"""{out}_f as (select frame_id, row, col, {', '.join(f'{f32(c)} as {c}' for c in P.CHANNELS)} from {src}),
{stencil(out + '_f', out + '_h', 'row', 'col', value)},
{stencil(out + '_h', out, 'col', 'row', value)}"""


def box(src: str, out: str, across: str, along: str) -> str:
    at = lambda c, k, d: f"{c}[greatest(1, least(n, {k} {'-' if d < 0 else '+'} {abs(d)}))]"
    return stencil(src, out, across, along, lambda c, k: "(" + " + ".join(at(c, k, d) for d in range(-6, 7)) + ") / 13")


def box3(src: str, out: str) -> str:
    parts, now = [], src
    for n in range(3):
        after = out if n == 2 else f"{out}_{n}"
        parts += [box(now, f"{out}_{n}h", "row", "col"), box(f"{out}_{n}h", after, "col", "row")]
        now = after
    return ",\n".join(parts)


def by_row(src: str, row="row", col="col") -> str:
    sums = ", ".join(r6(f"sum({c} * {w})", f"{p}_{c}") for c in P.CHANNELS for p, w in (("sum", "1e0"), ("at", f"({col} + 1)")))
    return f"select frame_id, {row} as row, count(*) n, {sums} from {src} group by frame_id, {row}"


def view(src: str, out: str, overscan: int) -> str:
    ranges = [f"{fn}({b} / step) {sign}" for fn, b, sign in (("floor", "min_x", f"- {overscan}"), ("ceil", "max_x", f"+ {overscan - 1}"), ("floor", "min_y", f"- {overscan}"), ("ceil", "max_y", f"+ {overscan - 1}"))]
    return f"{out}_s as (select *, power(2e0, lod) / 128 as step from {src}),\n{cells(out + '_s', out + '_c', *ranges)},\n{out} as (select *, (i + 0.5e0) * step as x, (j + 0.5e0) * step as y from {out}_c)"


def sample(src: str, out: str) -> str:
    """out: cells of src (frame_id, i, j, lod, x, y, step, t, travel_x) with channels and group states."""
    nine = "(values (-0.34e0), (0e0), (0.34e0))"
    return f"""{out}_kid as (select *, -1 child, lod plod, step span, x cx, y cy from {src} union all by name
  select s.*, k.child, lod - 1 plod, step / 2 span, x + k.kx * step cx, y + k.ky * step cy from {src} s, (values (0, -0.25e0, -0.25e0), (1, 0.25e0, -0.25e0), (2, -0.25e0, 0.25e0), (3, 0.25e0, 0.25e0)) k(child, kx, ky) where lod > 0),
{out}_p as (select *, cx + a.o * span px, cy + b.o * span py from {out}_kid, {nine} a(o), {nine} b(o) where plod > 0 or (a.o = 0 and b.o = 0)),
{field(f'(select * from {out}_p)', out + '_f', 'px', 'py')},
{out}_e as (select frame_id, i, j, lod, x, y, step, child, avg(rain) rain, {mix('avg(storm)', 'max(storm)', '0.58e0')} storm, {mix('avg(hail)', 'max(hail)', '0.72e0')} hail from {out}_f group by all),
{out}_s as (select *, {state()} st from {out}_e),
{out} as (select frame_id, i, j, lod, x, y, step, max(rain) filter (child < 0) rain, max(storm) filter (child < 0) storm, max(hail) filter (child < 0) hail,
  coalesce(max(case when st > 3 then 4 when st > 0 then 1 else 0 end) filter (child >= 0), max(st) filter (child < 0)) state from {out}_s group by frame_id, i, j, lod, x, y, step)"""


def placed(src: str, out: str) -> str:
    return f"{out} as (select s.*, center_x + (x - 0.5e0) * field_pixels * zoom sx, center_y + (y - 0.5e0) * field_pixels * zoom sy, step * field_pixels * zoom spacing, center_x, center_y, field_pixels, zoom from {src} s join frames using (frame_id))"


SAMPLES = f"{REGION},\n{view('frames', 'lat', 4)},\n{sample('lat', 'smp')},\n{placed('smp', 's')}"


def colour(src: str, out: str, rain, storm, hail, st, spacing, pre) -> str:
    """out: src with pre_r, pre_g, pre_b."""
    n = f"{out}_{pre}"
    blend = lambda p, q, t: f"floor({mix(p, q, clamp(t))} + 0.5e0)"
    each = lambda fn: ", ".join(f"{fn(k, c)} as {c}_{{}}".format(pre) for k, c in enumerate("rgb"))
    bg, rgb, sto, hai, strong_rgb = P.BACKGROUND, P.RAIN_RGB, P.STORM_RGB, P.HAIL_RGB, P.STRONG_RGB
    bright = "(rad - 0.4e0) / (full_rad - 0.4e0)"
    base = each(lambda k, c: f"case when rad <= 0.4e0 then {bg[k]}e0 else {blend(f'{bg[k]}e0', f'{rgb[k]}e0', bright)} end")
    drop = "exclude (" + ", ".join(f"{c}_{pre}" for c in "rgb") + ")"
    over = lambda target, amount, when: each(lambda k, c: f"case when {when} then {blend(f'{c}_{pre}', f'{target[k]}e0', amount)} else {c}_{pre} end")
    return f"""{n}1 as (select *, {radius(rain, spacing, 'rain')} rad, {radius('0.55e0', spacing, 'rain')} full_rad, {strong(rain)} strong_v,
  power({strength(storm, 'storm')}, 0.47e0) sprog, power({strength(hail, 'hail')}, 0.47e0) hprog from {src}),
{n}2 as (select *, power({strength('strong_v', 'rain')}, 0.47e0) rprog, {radius('strong_v', spacing, 'rain')} srad, {base} from {n}1),
{n}3 as (select * {drop}, {over(strong_rgb, 'rprog', 'srad > 0')} from {n}2),
{n}4 as (select * {drop}, {over(sto, mix('0.45e0', '1e0', 'sprog'), f'({st} > 0 and {st} <= 3) or ({st} > 3 and sprog > 0)')} from {n}3),
{out} as (select * exclude ({', '.join(f'{c}_{pre}' for c in 'rgb')}, rad, full_rad, strong_v, sprog, hprog, rprog, srad), rad > 0 or {st} > 0 as drawn_{pre}, {over(hai, mix('0.5e0', '1e0', 'hprog'), f'{st} > 3')} from {n}4)"""


def morph() -> str:
    half = lambda e: f"floor(({e}) / 2)"
    fine = "(power(2e0, fine) / 128)"
    ranges = [half(f"floor(min_x / {fine}) - 8"), half(f"ceil(max_x / {fine}) + 7"), half(f"floor(min_y / {fine}) - 8"), half(f"ceil(max_y / {fine}) + 7")]
    return f"""{REGION},
fine_frames as (select * replace (fine as lod) from frames),
{view('fine_frames', 'lat', 8)},
{sample('lat', 'kid')},
{cells('frames', 'up_c', *ranges)},
up as (select * replace (fine + 1 as lod), 2 * {fine} as step, (i + 0.5e0) * 2 * {fine} as x, (j + 0.5e0) * 2 * {fine} as y from up_c),
{sample('up', 'par')},
{placed('kid', 'kp')},
m as (select k.*, p.i parent_i, p.j parent_j, p.rain parent_rain, p.storm parent_storm, p.hail parent_hail, p.state parent_state,
  center_x + (p.x - 0.5e0) * field_pixels * zoom parent_sx, center_y + (p.y - 0.5e0) * field_pixels * zoom parent_sy,
  {step('0e0', '1e0', clamp('f.progress'))} progress
  from kp k join par p on k.frame_id = p.frame_id and p.i = floor(k.i / 2) and p.j = floor(k.j / 2) join (select frame_id, progress from frames) f on f.frame_id = k.frame_id)"""


MORPH = morph()
MOVED = f"{mix('parent_sx', 'sx', 'progress')} msx, {mix('parent_sy', 'sy', 'progress')} msy"


def weights(t: str) -> list[str]:
    u = f"(1e0 - {t})"
    return [f"{u} * {u} * {u} / 6e0", f"(3e0 * {t} * {t} * {t} - 6e0 * {t} * {t} + 4e0) / 6e0", f"(-3e0 * {t} * {t} * {t} + 3e0 * {t} * {t} + 3e0 * {t} + 1e0) / 6e0", f"{t} * {t} * {t} / 6e0"]


def axis(out: str, src: str, count: str, place: str, size: str, single: bool) -> str:
    w = [f32(x) if single else x for x in weights("(place - floor(place))")]
    return f"""{out}_p as (select *, {place} as place, {size} as size from (select *, unnest(range(0, {count})) as pos from {src})),
{out} as (select frame_id, pos, greatest(0, least(size - 1, cast(floor(place) as bigint) - 1 + k)) as src, case k when 0 then {w[0]} when 1 then {w[1]} when 2 then {w[2]} else {w[3]} end as w from {out}_p, (values (0), (1), (2), (3)) taps(k))"""


def rebuilt(src: str, out: str, xs: str, ys: str) -> str:
    s = ", ".join(f"sum({c} * w) as {c}" for c in P.CHANNELS)
    return f"""{out}_x as (select g.frame_id, g.row, a.pos px, {s} from {src} g join {xs} a on g.frame_id = a.frame_id and g.col = a.src group by all),
{out} as (select g.frame_id, a.pos py, px, {s} from {out}_x g join {ys} a on g.frame_id = a.frame_id and g.row = a.src group by all)"""


def raster() -> str:
    place = lambda n, screen, center, start: f"(((pos + 0.5e0) / {n}) * {screen} - {center}) / (field_pixels * zoom) * 128 + 64e0 - 0.5e0 - {start}"
    w, h = (f"cast(greatest(1, ceil({v} * 0.42e0)) as bigint)" for v in ("width", "height"))
    return f"""{REGION},
{grid(bounded=True)},
{gauss('g', 'sg')},
{axis('xa', 'gb', w, place(w, 'width', 'center_x', 'start_i'), 'end_i - start_i + 1', True)},
{axis('ya', 'gb', h, place(h, 'height', 'center_y', 'start_j'), 'end_j - start_j + 1', True)},
{rebuilt('sg', 'ra', 'xa', 'ya')}"""


RASTER = raster()


def nodes(extra: int, src: str) -> str:
    """Contour lattice nb (bounds) and nd (nodes in 64 bits) of the grid src, after grid(extra)."""
    st = "(1e0 / 384)"
    return f"""nb as (select *, cast(floor((travel_x - 0.92e0 - 4 * {st}) / {st}) as bigint) first_i, cast(ceil((travel_x + 0.92e0 + 4 * {st}) / {st}) as bigint) last_i,
  cast(floor((-0.26e0 - 4 * {st}) / {st}) as bigint) first_j, cast(ceil((1.26e0 + 4 * {st}) / {st}) as bigint) last_j from gb),
{axis('xa', 'nb', 'last_i - first_i + 1', '(first_i + pos) / 3e0 - 0.5e0 - start_i', 'end_i - start_i + 1', False)},
{axis('ya', 'nb', 'last_j - first_j + 1', '(first_j + pos) / 3e0 - 0.5e0 - start_j', 'end_j - start_j + 1', False)},
{rebuilt(src, 'nd', 'xa', 'ya')}"""


BANDS = "bands(channel, band, threshold, color) as (values " + ", ".join(f"('{c}', {b}, {num(t)}, '{h}')" for c, b, t, h in P.BANDS) + ")"


def long(src: str, out: str) -> str:
    return f"{out} as (" + " union all ".join(f"select frame_id, '{c}' channel, {c} as value from {src}" for c in P.CHANNELS) + ")"


def hist(src: str, out: str) -> str:
    return f"{out} as (select frame_id, channel, cast(greatest(0, least(1023, floor({clamp('value')} * 1024))) as integer) bin, count(*) n from {src} group by all)"


def thresholds(h: str, targets: str, out: str) -> str:
    return f"""{out}_c as (select *, sum(n) over (partition by frame_id, channel order by bin desc) cum from {h}),
{out}_m as (select t.frame_id, t.channel, t.band, max(bin) bin from {targets} t join {out}_c c on t.frame_id = c.frame_id and t.channel = c.channel and c.cum >= t.covered group by all),
{out} as (select t.*, case when t.covered <= 0 then 1e0 else coalesce((c.bin + 1 - (t.covered - (c.cum - c.n)) / cast(c.n as double)) / 1024, 0e0) end as value
  from {targets} t left join {out}_m m using (frame_id, channel, band) left join {out}_c c on c.frame_id = t.frame_id and c.channel = t.channel and c.bin = m.bin)"""


def targets(src: str, out: str) -> str:
    return f"{out} as (select frame_id, channel, band, count(*) filter (value >= threshold) covered from {src} join bands using (channel) group by all)"


def cell_rows() -> str:
    lists = ", ".join(f"list({f32(c)} order by px) {c}" for c in P.CHANNELS)
    each = " union all ".join(
        f"select frame_id, '{c}' channel, py as row, unnest(range(0, len({c}) - 1)) col, unnest({c}[:-2]) a, unnest({c}[2:]) b, unnest({c}_below[2:]) c, unnest({c}_below[:-2]) d from strips" for c in P.CHANNELS
    )
    return f"""{REGION},
{BANDS},
{grid()},
{gauss('g', 'sg')},
{nodes(0, 'sg')},
node_rows as (select frame_id, py, {lists} from nd group by frame_id, py),
strips as materialized (select u.*, {', '.join(f'l.{c} {c}_below' for c in P.CHANNELS)} from node_rows u join node_rows l on l.frame_id = u.frame_id and l.py = u.py + 1),
quads as ({each}),
crossed as (select * from quads join bands using (channel) where least(a, b, c, d) < threshold and threshold <= greatest(a, b, c, d))"""


CELLS = cell_rows()


#: The edges (top, right, bottom, left) that the line joins in each case; corners that reach the threshold
#: count 1 (top left), 2 (top right), 4 (bottom right), 8 (bottom left). Of 5 and 10, the first where the mean reaches it.
LINES = {
    1: "T-L", 2: "R-T", 3: "R-L", 4: "B-R", 5: ("T-R B-L", "T-L R-B"), 6: "B-T", 7: "B-L",
    8: "L-B", 9: "T-B", 10: ("T-L R-B", "T-R B-L"), 11: "R-B", 12: "L-R", 13: "T-R", 14: "L-T",
}


def segments() -> str:
    share = lambda p, q: f"(threshold - {p}) / nullif({q} - {p}, 0) / 384"
    points = {"T": ("te", f"x0 + {share('a', 'b')}", "y0"), "R": ("re", "x0 + 1e0 / 384", f"y0 + {share('b', 'c')}"), "B": ("be", f"x0 + {share('d', 'c')}", "y0 + 1e0 / 384"), "L": ("le", "x0", f"y0 + {share('a', 'd')}")}
    rows = []
    mean = "((a + b + c + d) / 4 >= threshold)"
    cases = [(f"idx = {n}", x) for n, x in LINES.items() if isinstance(x, str)]
    cases += [(f"idx = {n} and {side}", x) for n, both in LINES.items() if not isinstance(both, str) for side, x in zip((mean, f"not {mean}"), both, strict=True)]
    for when, lines in cases:
        for pair in lines.split():
            (ea, ax, ay), (eb, bx, by) = (points[e] for e in pair.split("-"))
            rows.append(f"select frame_id, channel, band, row, col, {ea} edge_a, {eb} edge_b, {ax} ax, {ay} ay, {bx} bx, {by} b_y from idx where {when}")
    bit = lambda c, n: f"case when {c} >= threshold then {n} else 0 end"
    return f"""{CELLS},
idx as materialized (select *, (first_i + col) / 384e0 x0, (first_j + row) / 384e0 y0, row * (cols - 1) + col te, (row + 1) * (cols - 1) + col be, hc + row * cols + col le, hc + row * cols + col + 1 re,
  {bit('a', 1)} + {bit('b', 2)} + {bit('c', 4)} + {bit('d', 8)} idx
  from (select c.*, first_i, first_j, last_i - first_i + 1 cols, (last_j - first_j + 1) * (last_i - first_i) hc from crossed c join nb using (frame_id))),
seg as materialized ({' union all '.join(rows)})"""


SEGMENTS = segments()
LOOPS = f"""{SEGMENTS},
half as (select frame_id, channel, band, edge_a e, edge_b f, ax x, ay y from seg union all select frame_id, channel, band, edge_b, edge_a, bx, b_y from seg),
reach(frame_id, channel, band, s, e) as (select distinct frame_id, channel, band, e, e from half union select r.frame_id, r.channel, r.band, r.s, h.f from reach r join half h on h.frame_id = r.frame_id and h.channel = r.channel and h.band = r.band and h.e = r.e where h.f > r.s),
labelled as (select frame_id, channel, band, e, min(s) loop_id from reach group by all),
spot as (select frame_id, channel, band, e, min(x) x, min(y) y from half group by all)"""
#: From each loop's smallest edge to its smaller neighbour and on: k steps on the way, from prev to e.
WALK = f"""{LOOPS},
beside as materialized (select frame_id, channel, band, e, min(f) p, max(f) q from half group by all),
walk(frame_id, channel, band, loop_id, e, prev, k) as (select frame_id, channel, band, e, e, q, 0 from beside join labelled using (frame_id, channel, band, e) where e = loop_id
  union all select * from (select w.frame_id, w.channel, w.band, w.loop_id, case when b.p = w.prev then b.q else b.p end e, w.e prev, w.k + 1 k from walk w join beside b using (frame_id, channel, band, e)) where e <> loop_id)"""


def ordered(columns: str) -> str:
    return f"ev as (select *, row_number() over (partition by user_id order by ts, event_id) k{columns} from points)"


def _lod_fold() -> str:
    """State: the level at rest, the cell [lo, lo + 1] under way, and p of the way from its upper to its lower end."""
    lo = "coalesce(s.lo, case when n.desired < s.level then s.level - 1 when n.desired > s.level then s.level end)"
    p = "coalesce(s.p, case when n.desired < s.level then 0e0 else 1e0 end)"
    return f"""with recursive {POINTS},
{ordered(', 0.02e0 + (event_id % 5) * 0.02e0 delta, cast((event_id * 7 + user_id) % 6 as integer) desired')},
s(user_id, k, event_id, level, lo, p, sign) as (
  select user_id, k, event_id, desired, cast(null as integer), cast(null as double), cast(null as integer) from ev where k = 1
  union all select user_id, k, event_id, case when q >= 1 then lo when q <= 0 then lo + 1 else level end, case when q > 0 and q < 1 then lo end, case when q > 0 and q < 1 then q end, case when q > 0 and q < 1 then sign end
  from (select *, p + sign * delta / 0.2e0 q from (select *, case when desired > lo then -1 when lo is not null then 1 end sign from (
    select n.user_id, n.k, n.event_id, n.delta, n.desired, s.level, {lo} lo, {p} p from s join ev n on n.user_id = s.user_id and n.k = s.k + 1))))
select event_id, level, lo + 1 coarse, lo fine, {r6('p', 'progress')}, sign direction from s"""


def _zoom(kind: str, amount: str, touches: str, wheel: str) -> str:
    """Recursion over events; kind, amount (pixels or distance) and touches are of event n, z is the state before it."""
    begins, moves = f"{kind} = 'touchstart' and {touches} = 2", f"{kind} = 'touchmove' and {touches} = 2 and z.apart > 0"
    zoom = f"case when {kind} in ('touchstart', 'touchend') or ({kind} = 'touchmove' and not ({moves})) then z.zoom else greatest(0.1e0, least(5.5e0, case when {moves} then z.begun * {amount} / z.apart when {kind} = 'reset' then 1e0 when {kind} = 'in' then z.zoom * 1.28e0 when {kind} = 'out' then z.zoom / 1.28e0 else z.zoom * exp(-({wheel}) * 0.00125e0) end)) end"
    return f"""with recursive {POINTS}, {ordered("")}, z(user_id, k, event_id, zoom, begun, apart) as (
  select user_id, cast(0 as bigint), cast(null as bigint), 1e0, 1e0, 0e0 from (select distinct user_id from ev)
  union all select n.user_id, n.k, n.event_id, {zoom}, case when {begins} then z.zoom else z.begun end, case when {begins} then {amount} when {kind} = 'touchend' and {touches} < 2 then 0e0 else z.apart end
  from z join ev n on n.user_id = z.user_id and n.k = z.k + 1)"""


def _scrub() -> str:
    kind = "case n.event_type when 'view' then 'tick' when 'purchase' then 'down' when 'signup' then 'move' when 'click' then 'toggle' else case n.event_id % 3 when 0 then 'up' when 1 then 'cancel' else 'input' end end"
    value = "floor(greatest(0e0, least(1e0, (n.value - 20e0) / 400e0)) * 1000 + 0.5e0) / 1000 * 18e0"
    return f"""with recursive {POINTS}, {ordered("")}, doing as (select *, {kind} a, event_id % 2 p, {value} v, (event_id % 15) / 100e0 delta from ev n),
s(user_id, k, event_id, playing, scrubbing, time, pointer) as (
  select user_id, cast(0 as bigint), cast(null as bigint), true, false, 0e0, cast(null as bigint) from (select distinct user_id from ev)
  union all select n.user_id, n.k, n.event_id, case n.a when 'down' then false when 'toggle' then not s.playing else s.playing end,
    case when n.a = 'down' then true when n.a in ('up', 'cancel') and n.p = s.pointer then false else s.scrubbing end,
    case when n.a in ('down', 'input') or (n.a = 'move' and n.p = s.pointer) then n.v when n.a = 'tick' and s.playing and not s.scrubbing then fmod(s.time + least(n.delta, 0.1e0), 18e0) else s.time end,
    case when n.a = 'down' then n.p when n.a in ('up', 'cancel') and n.p = s.pointer then null else s.pointer end
  from s join doing n on n.user_id = s.user_id and n.k = s.k + 1)
select event_id, playing, scrubbing, {r6('time')} from s where k > 0"""


def _hazard_opacity(v, onset, visible, strong_at, core, tail) -> str:
    return f"(case when {v} < {visible} then 0.4e0 * power({step(onset, visible, v)}, {tail}) when {v} < {strong_at} then {mix('0.4e0', '0.65e0', step(visible, strong_at, v))} else {mix('0.65e0', '1e0', step(strong_at, core, v))} end)"


OPACITY = {
    "rain": f"power({step('0.006e0', '0.52e0', 'rain')}, 0.66e0)",
    "storm": _hazard_opacity("storm", "0.006e0", "0.03375e0", "0.075e0", "0.54e0", "0.76e0"),
    "hail": _hazard_opacity("hail", "0.01e0", "0.0495e0", "0.11e0", "0.44e0", "0.68e0"),
}


def _over(src, out, rgb, a) -> str:
    alpha = f"({a} + a * (1e0 - {a}))"
    mixed = ", ".join(f"case when {a} > 0 then ({t}e0 * {a} + {c} * a * (1e0 - {a})) / {alpha} else {c} end as {c}" for c, t in zip("rgb", rgb, strict=True))
    return f"{out} as (select * replace ({mixed}, case when {a} > 0 then {alpha} else a end as a) from {src})"


BLUR = f"""{RASTER},
b0 as (select frame_id, py, px, 0e0 r, {mix('144e0', '0e0', step('0.55e0', '0.9e0', 'rain'))} g, 255e0 b, {OPACITY['rain']} a, {OPACITY['storm']} s_a, {OPACITY['hail']} h_a from ra),
{_over('b0', 'b1', P.STORM_RGB, 's_a')},
{_over('b1', 'b2', P.HAIL_RGB, 'h_a')},
px8 as (select frame_id, py, px, cast(floor(r + 0.5e0) as integer) r, cast(floor(g + 0.5e0) as integer) g, cast(floor(b + 0.5e0) as integer) b, cast(floor(a * 255 + 0.5e0) as integer) a from b2)"""

SMOOTH = f"""{REGION},
{BANDS},
{grid(18)},
{gauss('g', 'sg')},
{box3('sg', 'bg')},
{{inside}}"""


def _inside(src, out) -> str:
    at = lambda k, low, high: f"{k} >= ceil(({low}) * 128 - 0.5e0) and {k} <= floor(({high}) * 128 - 0.5e0)"
    return f"{out} as (select s.* from {src} s join gb using (frame_id) where {at('col + start_i', 'travel_x - 0.92e0', 'travel_x + 0.92e0')} and {at('row + start_j', '-0.26e0', '1.26e0')})"


def _coverage_bands() -> str:
    eff, prev = [], "0e0"
    for b in range(5):
        eff.append(f"e{b} as (select *, {f32(f'greatest({prev}, least({num(1 - (4 - b) * 1e-5)}, v{b}))')} e{b} from {'wide' if b == 0 else f'e{b - 1}'})")
        prev = f"e{b} + 1e-5"
    inside = ",\n".join([_inside("sg", "si"), _inside("bg", "bi"), long("si", "lo"), long("bi", "lg"), targets("lo", "tg"), hist("lg", "hh"), thresholds("hh", "tg", "th")])
    return f"""with {SMOOTH.format(inside=inside)},
wide as (select frame_id, {', '.join(f'max(value) filter (band = {b}) v{b}' for b in range(5))} from th where channel = 'rain' group by frame_id),
{', '.join(eff)}
select frame_id, channel, band, {r6('value', 'threshold')} from th where channel <> 'rain' union all {' union all '.join(f"select frame_id, 'rain', {b}, {r6(f'e{b}', 'threshold')} from e4" for b in range(5))}"""


def _vertices(kind, n, inner) -> str:
    return f"select event_id, cast(k as integer) point, x + cos(k * (2e0 * {PI} / {n}) - {PI} / 2e0) * {inner} px, y + sin(k * (2e0 * {PI} / {n}) - {PI} / 2e0) * {inner} py from sym, range(0, {n}) ks(k) where kind = '{kind}'"


SYM = f"""{VALUES},
vs as (select *, {state()} state from v),
sym0 as (select *, case when state > 3 then 'hail' else 'storm' end kind, {hazard_radius('storm', 'hail', 'state', '11.5e0')} radius from vs),
sym as (select * from sym0 where radius > 0)"""

SPACING = "spacing"
DOTS = f"""{SAMPLES},
d as (select frame_id, 0 layer, 'rain' kind, i, j, sx, sy, {radius('rain', SPACING, 'rain')} radius, '#0090FF' color from s
 union all select frame_id, 1, 'strong', i, j, sx, sy, {radius(strong('rain'), SPACING, 'rain')}, '#0000FF' from s
 union all select frame_id, 2, 'hazard', i, j, sx, sy, {hazard_radius('storm', 'hail', 'state', SPACING)}, case when state > 3 then '#FFD400' else '#FF00FF' end from s)"""

SQL = {
    "events_hazard_counts": f"with {VALUES} select event_type, {state()} hazard_state, count(*) n, {r6('avg(rain)', 'avg_rain')} from v group by all",
    "field_lattice": f"with {REGION}, {grid()} {by_row('g')}",
    "lattice_band_counts": f"with {REGION}, {BANDS}, {grid()}, {long('g', 'l')}, {targets('l', 'tg')} select * from tg",
    "cell_events": f"with {POINTS}, c as (select cast(floor(x * 32) as bigint) i, cast(floor(y * 32) as bigint) j, count(*) n, avg(value) mean from points group by all) "
    f"select a.i, b.j, {r6('(a.i + 0.5e0) / 32', 'x')}, {r6('(b.j + 0.5e0) / 32', 'y')}, coalesce(n, 0) n, {r6('mean')} from range(0, 32) a(i), range(0, 32) b(j) left join c on c.i = a.i and c.j = b.j",
    "point_field_lineitem": f"with pts as (select l_returnflag, l_linestatus, (l_partkey % 128 + 0.5e0) / 128 x, (l_suppkey % 128 + 0.5e0) / 128 y, l_quantity / 51 t, 0.5e0 travel_x from lineitem), {field('pts', 'v')} "
    f"select l_returnflag, l_linestatus, count(*) n, {', '.join(r6(f'sum({c})', f'sum_{c}') for c in P.CHANNELS)}, {', '.join(r6(f'max({c})', f'max_{c}') for c in P.CHANNELS)} from v group by all",
    "strength": f"with {VALUES} select event_id, {', '.join(r6(strength(c, c), c) for c in P.CHANNELS)} from v",
    "hazard_state": f"with {VALUES}, vs as (select event_id, {state()} state from v) select event_id, state, case when state > 3 then 'hail' else 'storm' end kind, case when state > 3 then '#FFD400' else '#FF00FF' end color from vs",
    "dot_radius": f"with {VALUES} select event_id, {', '.join(r6(radius(c, '11.5e0', c), c) for c in P.CHANNELS)} from v",
    "strong_rain": f"with {VALUES} select event_id, {r6(strong('rain'), 'strong')}, {r6(radius(strong('rain'), '11.5e0', 'rain'), 'radius')} from v",
    "square_color": f"with {VALUES}, vs as (select *, {state()} state from v), {colour('vs', 'cc', 'rain', 'storm', 'hail', 'state', '11.5e0', 'c')} "
    "select event_id, cast(r_c as integer) r, cast(g_c as integer) g, cast(b_c as integer) b, format('rgb({} {} {})', cast(r_c as integer), cast(g_c as integer), cast(b_c as integer)) css, drawn_c drawn from cc",
    "hazard_symbol": f"with {SYM} select event_id, kind, {r6('radius')} from sym",
    "symbol_vertices": f"with {SYM} select event_id, point, {r6('px')}, {r6('py')} from ({_vertices('hail', 6, 'radius')} union all {_vertices('storm', 8, '(case when k % 2 = 0 then radius else radius * 0.38e0 end)')})",
    "band_colors": f"with {VALUES}, {BANDS}, top as (select event_id, max(band) band from v join bands on channel = 'rain' and threshold <= rain group by event_id) select event_id, band, "
    + ", ".join(f"cast('0x' || substr(color, {2 + 2 * k}, 2) as integer) {c}" for k, c in enumerate("rgb")) + " from top join bands using (band) where channel = 'rain'",
    "blur_opacity": f"with {VALUES} select event_id, {', '.join(r6(v, c) for c, v in OPACITY.items())} from v",
    "viewport_bounds": f"with {CUSTOMER} select frame_id, {', '.join(map(r6, ('field_pixels', 'center_x', 'center_y', 'min_x', 'max_x', 'min_y', 'max_y')))} from frames",
    "travel_path": f"with {CUSTOMER} select frame_id, {r6('travel_x')} from frames",
    "select_lod": f"with {CUSTOMER} select frame_id, lod, {r6('continuous')} from frames",
    "lod_sample": f"with {SAMPLES} select frame_id, lod, i, j, {', '.join(map(r6, (*P.CHANNELS, 'sx', 'sy')))} from s",
    "lod_hazard_group": f"with {SAMPLES} select frame_id, lod, state, count(*) n, cast(sum(i) as bigint) sum_i, cast(sum(j) as bigint) sum_j from s group by all",
    "dots_layers": f"with {DOTS} select frame_id, layer, kind, i, j, color, {', '.join(map(r6, ('sx', 'sy', 'radius')))} from d where radius > 0",
    "squares_cells": f"with {SAMPLES}, {colour('s', 'cc', 'rain', 'storm', 'hail', 'state', SPACING, 'c')} select frame_id, i, j, cast(r_c as integer) r, cast(g_c as integer) g, cast(b_c as integer) b, "
    f"{r6('sx - spacing / 2', 'x0')}, {r6('sy - spacing / 2', 'y0')}, {r6('spacing + 0.5e0', 'size')} from cc where drawn_c",
    "lod_parent_join": f"with {MORPH} select frame_id, i, j, parent_i, parent_j, state, parent_state, {', '.join(r6(f'parent_{c}') for c in P.CHANNELS)}, {r6('progress')} from m",
    "dots_morph": f"with {MORPH}, mv as (select *, {MOVED} from m), d as (select frame_id, 0 layer, i, j, msx, msy, {mix(radius('parent_rain', '(2 * spacing)', 'rain'), radius('rain', SPACING, 'rain'), 'progress')} radius from mv "
    f"union all select frame_id, 1, i, j, msx, msy, {mix(radius(strong('parent_rain'), '(2 * spacing)', 'rain'), radius(strong('rain'), SPACING, 'rain'), 'progress')} from mv) "
    f"select frame_id, layer, i, j, {r6('msx', 'sx')}, {r6('msy', 'sy')}, {r6('radius')} from d where radius > 0",
    "hazard_morph": f"with {MORPH}, mv as (select *, {MOVED}, {state()} st from m), d as (select *, {mix(hazard_radius('storm', 'hail', 'st', '(2 * spacing)'), hazard_radius('storm', 'hail', 'st', SPACING), 'progress')} radius from mv) "
    f"select frame_id, i, j, case when st > 3 then 'hail' else 'storm' end kind, case when st > 3 then '#FFD400' else '#FF00FF' end color, {r6('msx', 'sx')}, {r6('msy', 'sy')}, {r6('radius')} from d where radius > 0",
    "squares_morph": f"with {MORPH}, {colour('m', 'c1', 'rain', 'storm', 'hail', 'state', SPACING, 'f')}, {colour('c1', 'c2', 'parent_rain', 'parent_storm', 'parent_hail', 'parent_state', '(2 * spacing)', 'p')} "
    f"select frame_id, i, j, {', '.join(f'cast(floor({mix(f'{c}_p', f'{c}_f', clamp('progress'))} + 0.5e0) as integer) {c}' for c in 'rgb')}, {r6('sx - spacing / 2', 'x0')}, {r6('sy - spacing / 2', 'y0')} from c2",
    "gauss_smooth": f"with {REGION}, {grid()}, {gauss('g', 'sg')} {by_row('sg')}",
    "box_blur": f"with {REGION}, {grid()}, {box('g', 'bg', 'row', 'col')} {by_row('bg')}",
    "box_blur_3pass": f"with {REGION}, {grid(18)}, {box3('g', 'bg')} {by_row('bg')}",
    "spline_raster": f"with {RASTER} {by_row('ra', 'py', 'px')}",
    "spline_lattice": f"with {REGION}, {grid()}, {gauss('g', 'sg')}, {nodes(0, 'sg')} {by_row('nd', 'py', 'px')}",
    "spline_points": f"with {POINTS}, {REGION}, {grid()}, {gauss('g', 'sg')}, pt as (select p.event_id, gb.frame_id, p.x * 128 - 0.5e0 - start_i gx, p.y * 128 - 0.5e0 - start_j gy, end_i - start_i + 1 w, end_j - start_j + 1 h from points p join gb on gb.frame_id = p.event_id % 5), "
    "tx as (select *, kx, greatest(0, least(w - 1, cast(floor(gx) as bigint) - 1 + kx)) col, gx - floor(gx) fx, ky, greatest(0, least(h - 1, cast(floor(gy) as bigint) - 1 + ky)) as row, gy - floor(gy) fy from pt, range(0, 4) a(kx), range(0, 4) b(ky)), "
    f"tw as (select *, case kx when 0 then {weights('fx')[0]} when 1 then {weights('fx')[1]} when 2 then {weights('fx')[2]} else {weights('fx')[3]} end * case ky when 0 then {weights('fy')[0]} when 1 then {weights('fy')[1]} when 2 then {weights('fy')[2]} else {weights('fy')[3]} end wt from tx) "
    f"select event_id point_id, {', '.join(r6(f'sum({c} * wt)', c) for c in P.CHANNELS)} from tw join sg on tw.frame_id = sg.frame_id and tw.row = sg.row and tw.col = sg.col group by event_id",
    "blur_raster": f"with {BLUR} select frame_id, cast(py as integer) py, count(*) n, {', '.join(f'cast(sum({c}) as bigint) sum_{c}' for c in 'rgba')}, cast(sum(a * px) as bigint) at_a from px8 group by frame_id, py",
    "coverage_histogram": f"with {REGION}, {grid()}, {long('g', 'l')}, {hist('l', 'hh')} select * from hh",
    "coverage_threshold": f"with {REGION}, {BANDS}, {grid()}, {box('g', 'bg', 'row', 'col')}, {long('g', 'lo')}, {long('bg', 'lg')}, {targets('lo', 'tg')}, {hist('lg', 'hh')}, {thresholds('hh', 'tg', 'th')} select frame_id, channel, band, covered, {r6('value')} from th",
    "coverage_bands": _coverage_bands(),
    "contour_cells": f"with {CELLS} select frame_id, channel, band, cast(row as integer) as row, cast(col as integer) col, {', '.join(map(r6, 'abcd'))} from crossed",
    "contour_segments": f"with {SEGMENTS} select frame_id, channel, band, cast(row as integer) as row, cast(col as integer) col, cast(edge_a as bigint) edge_a, cast(edge_b as bigint) edge_b, {', '.join(map(r6, ('ax', 'ay', 'bx')))}, {r6('b_y', QUOTED)} from seg",
    "contour_loops": f"with recursive {WALK} select frame_id, channel, band, cast(loop_id as bigint) loop_id, count(*) points, {r6('sum(x)', 'sum_x')}, {r6('sum(y)', 'sum_y')}, {r6('sum(k * x)', 'at_x')}, {r6('sum(k * y)', 'at_y')} from walk join spot using (frame_id, channel, band, e) group by all",
    "loop_nesting": f"""with recursive {LOOPS},
loop as (select frame_id, channel, band, loop_id, count(*) points from labelled group by all),
probe as (select l.*, s.x px, s.y py from loop l join spot s on s.frame_id = l.frame_id and s.channel = l.channel and s.band = l.band and s.e = l.loop_id),
side as (select l.frame_id, l.channel, l.band, l.loop_id, a.x ax, a.y ay, b.x bx, b.y b_y from seg join labelled l on l.frame_id = seg.frame_id and l.channel = seg.channel and l.band = seg.band and l.e = edge_a
  join spot a on a.frame_id = seg.frame_id and a.channel = seg.channel and a.band = seg.band and a.e = edge_a join spot b on b.frame_id = seg.frame_id and b.channel = seg.channel and b.band = seg.band and b.e = edge_b),
holds as materialized (select p.frame_id, p.channel, p.band, p.loop_id, s.loop_id outer_id from probe p join side s using (frame_id, channel, band)
  where s.loop_id <> p.loop_id and (ay > py) <> (b_y > py) and px < ax + (py - ay) / (b_y - ay) * (bx - ax) group by all having count(*) % 2 = 1),
depth as (select frame_id, channel, band, loop_id, count(*) depth from holds group by all),
parent as (select h.frame_id, h.channel, h.band, h.loop_id, arg_max(outer_id, coalesce(d.depth, 0)) parent_loop from holds h left join depth d on d.frame_id = h.frame_id and d.channel = h.channel and d.band = h.band and d.loop_id = h.outer_id group by all)
select frame_id, channel, band, cast(loop_id as bigint) loop_id, points, coalesce(depth, 0) depth, cast(parent_loop as bigint) parent_loop from loop left join depth using (frame_id, channel, band, loop_id) left join parent using (frame_id, channel, band, loop_id)""",
    "area_layers": f"with recursive {LOOPS}, pts as (select spot.frame_id, channel, band, center_x + (spot.x - 0.5e0) * field_pixels * zoom px, center_y + (spot.y - 0.5e0) * field_pixels * zoom py, field_pixels * zoom scale from spot join frames using (frame_id)), "
    "st as (select *, case channel when 'rain' then band when 'storm' then 5 else 6 end layer, 'fill' style, case channel when 'rain' then 1e0 when 'storm' then 0.45e0 else 0.35e0 end alpha, cast(null as double) line_width from pts "
    "union all select *, case channel when 'storm' then 7 else 8 end, 'line', 1e0, 1.25e0 / scale from pts where channel <> 'rain') "
    f"select frame_id, cast(layer as integer) layer, style, channel, band, color, {r6('alpha')}, {r6('line_width')}, count(*) points, {r6('sum(px)', 'sum_px')}, {r6('sum(py)', 'sum_py')} from st join bands using (channel, band) group by frame_id, layer, style, channel, band, color, alpha, line_width",
    "timeline_fold": f"with {POINTS}, {ordered(', (event_id % 15) / 100e0 delta')}, pl as (select *, sum(case when event_type = 'click' then 1 else 0 end) over (partition by user_id order by k) % 2 = 0 playing from ev) "
    f"select event_id, playing, {r6('sum(case when playing then least(delta, 0.1e0) else 0e0 end) over (partition by user_id order by k) % 18e0', 'time')} from pl",
    "timeline_pointer": f"with {POINTS} select event_id, {r6('floor(greatest(0e0, least(1e0, (value - 20e0) / 400e0)) * 1000 + 0.5e0) / 1000 * 18e0', 'time')}, {r6('sqrt((x - t) * (x - t) + (y - travel_x) * (y - travel_x))', 'distance')} from points",
    "zoom_fold": _zoom(
        "(case n.event_type when 'signup' then 'in' when 'purchase' then 'out' when 'error' then 'reset' when 'view' then 'wheel' else case n.event_id % 7 when 0 then 'touchstart' when 6 then 'touchend' else 'touchmove' end end)",
        "(40e0 + n.event_id % 200)", "(case when n.event_id % 5 < 4 then 2 else 1 end)", "(n.value - 250e0) * 4e0",
    ) + f" select event_id, {r6('zoom')} from z where k > 0",
    "pinch_fold": _zoom(
        "(case n.event_id % 8 when 0 then 'touchstart' when 6 then 'touchend' when 7 then 'wheel' else 'touchmove' end)", "cast(n.event_id * 13 % 300 as double)", "(case when n.event_id % 11 < 9 then 2 else 1 end)", "n.value - 250e0",
    ) + f" select event_id, {r6('zoom')}, {r6('begun', 'start_zoom')}, {r6('apart', 'start_distance')} from z where k > 0",
    "scrub_fold": _scrub(),
    "mode_fold": f"with {POINTS}, {ordered('')}, se as (select *, case when event_type = 'click' then case event_id % 4 when 0 then 'dots' when 1 then 'squares' when 2 then 'blur' else 'areas' end end m, case when event_type = 'signup' then event_id % 2 = 0 end sm from ev) "
    "select event_id, coalesce(last_value(m ignore nulls) over (partition by user_id order by k), 'dots') render_mode, coalesce(last_value(sm ignore nulls) over (partition by user_id order by k), false) area_smooth from se",
    "canvas_size": "with s as (select c_custkey frame_id, greatest(1, c_custkey * 37 % 1500 - 40) width, greatest(1, c_custkey * 53 % 900 - 20) height, case when c_custkey % 5 = 0 then 1e0 else (c_custkey % 5) / 2e0 end dpr from customer) "
    "select frame_id, width, height, cast(floor(width * dpr + 0.5e0) as bigint) canvas_width, cast(floor(height * dpr + 0.5e0) as bigint) canvas_height from s",
    "lod_transition_fold": _lod_fold(),
}

#: Frames of region at level fine, as render_dots and render_squares draw those with even keys; the others are between levels.
AT_FINE = REGION[: REGION.rindex("cast(floor(")] + "fine as lod from framed)"
SQL["render_dots"] = f"""select * from ({SQL['dots_layers'].replace(REGION, AT_FINE)}) where frame_id % 2 = 0
union all by name select *, case layer when 0 then 'rain' else 'strong' end kind, case layer when 0 then '#0090FF' else '#0000FF' end color from ({SQL['dots_morph']}) where frame_id % 2 = 1
union all by name select * exclude (kind), 'hazard' kind, 2 layer from ({SQL['hazard_morph']}) where frame_id % 2 = 1"""
SQL["render_squares"] = f"""select * from ({SQL['squares_cells'].replace(REGION, AT_FINE)}) where frame_id % 2 = 0
union all by name select *, {r6("power(2e0, frame_id % 3) / 128 * 828 * (0.4e0 + frame_id * 0.3e0) + 0.5e0", "size")} from ({SQL['squares_morph']}) where frame_id % 2 = 1"""


def _areas_smooth() -> str:
    """The layers of areas over the generalised grid, with the thresholds that keep each band's coverage."""
    bands = _coverage_bands()
    head = bands[len("with ") : bands.rindex("\nselect frame_id, channel, band")]
    moved = "sb as (select frame_id, channel, band, value threshold from th where channel <> 'rain' union all " + " union all ".join(f"select frame_id, 'rain', {b}, e{b} from e4" for b in range(5)) + ")"
    plain = f"{REGION},\n{BANDS},\n{grid()},\n{gauss('g', 'sg')},\n{nodes(0, 'sg')}"
    return SQL["area_layers"].replace(plain, f"{head},\n{moved},\n{nodes(18, 'bg')}").replace("quads join bands using (channel)", "quads join sb using (frame_id, channel)")


SQL["area_layers_smooth"] = _areas_smooth()
