"""Pieces of DuckDB SQL that the queries' counterparts share: numbers, pixels, clipping, line and area walks, packed colours."""

from __future__ import annotations

from tessera.functions.canvas import Axis, Canvas


def number(v: float) -> str:
    """An exact double."""
    return f"'{float(v)!r}'::double"


def place(axis: Axis, e: str) -> str:
    m = f"log10({e})" if axis.kind == "log" else f"({e})"
    return f"({m} * {number(axis.scale)} + {number(axis.shift)})"


def inside(axis: Axis, e: str) -> str:
    return f"{e} between {number(axis.range[0])} and {number(axis.range[1])}"


def pixel(axis: Axis, e: str) -> str:
    return f"least(cast(trunc({place(axis, e)}) as int), {axis.size - 1})"


def vertex(axis: Axis, e: str) -> str:
    end = round(axis.number(axis.range[1]) * axis.scale + axis.shift)
    at = f"cast(trunc({place(axis, e)}) as int)"
    return f"(case when {at} = {end} then {end - 1} else {at} end)"


def hits(source: str, canvas: Canvas, x: str = "x", y: str = "y") -> str:
    """CTEs src and hit: the source's rows inside the canvas with px and py."""
    return (
        f"src as ({source}), hit as (select *, {pixel(canvas.x, x)} as px, {pixel(canvas.y, y)} as py "
        f"from src where {inside(canvas.x, x)} and {inside(canvas.y, y)})"
    )


def bresenham(minor: str, k: str, major: str, back: str) -> str:
    return f"((2 * {minor} * {k} + {major} - (case when {back} then 1 else 0 end)) // greatest(2 * {major}, 1))"


def line_pixels(segments: str, canvas: Canvas, name: str = "walk") -> str:
    """CTEs ending in `name`: a row for each pixel of segments(x0, y0, x1, y1, s, ...), s: the segment begins a line."""
    (xa, xb), (ya, yb) = ([number(v) for v in r] for r in (canvas.x.range, canvas.y.range))
    enter = ", ".join(f"case when d{c} > 0 then ({a} - {c}0) / d{c} when d{c} < 0 then ({b} - {c}0) / d{c} end" for c, a, b in (("x", xa, xb), ("y", ya, yb)))
    leave = ", ".join(f"case when d{c} > 0 then ({b} - {c}0) / d{c} when d{c} < 0 then ({a} - {c}0) / d{c} end" for c, a, b in (("x", xa, xb), ("y", ya, yb)))
    ends = [f"{f'case when t0 > 0 then {c}0 + t0 * d{c} else {c}0 end'} as from{c}, {f'case when t1 < 1 then {c}0 + t1 * d{c} else {c}1 end'} as upto{c}" for c in "xy"]
    steps = "(case when wide then k else {m} end)", "(case when wide then {m} else k end)"
    m = bresenham("minor", "k", "major", "(case when wide then ix else iy end) < 0")
    return f"""seg as ({segments}),
dif as (select *, x1 - x0 as dx, y1 - y0 as dy from seg where x0 is not null and x1 is not null and y0 is not null and y1 is not null),
lim as (select *, greatest(0.0::double, {enter}) as t0, least(1.0::double, {leave}) as t1 from dif
        where (dx <> 0 or x0 between {xa} and {xb}) and (dy <> 0 or y0 between {ya} and {yb})),
cut as (select *, {', '.join(ends)} from lim where t0 <= t1),
pix as (select *, {vertex(canvas.x, 'fromx')} as pa, {vertex(canvas.y, 'fromy')} as qa, {vertex(canvas.x, 'uptox')} as pb, {vertex(canvas.y, 'uptoy')} as qb from cut),
dir as (select *, sign(pb - pa)::int as ix, sign(qb - qa)::int as iy, abs(pb - pa) >= abs(qb - qa) as wide,
        greatest(abs(pb - pa), abs(qb - qa)) as major, least(abs(pb - pa), abs(qb - qa)) as minor from pix),
stp as (select *, unnest(range(case when s or t0 > 0 or (t1 >= 1 and major = 0) then 0 else 1 end, major + 1)) as k from dir),
{name} as (select * from (select *, (pa + ix * {steps[0].format(m=m)})::int as px, (qa + iy * {steps[1].format(m=m)})::int as py from stp)
         where px between 0 and {canvas.plot_width - 1} and py between 0 and {canvas.plot_height - 1})"""


def area_pixels(segments: str, canvas: Canvas, stacked: bool, name: str = "walk") -> str:
    """CTEs ending in `name`: a row for each pixel of trapezoids(x0, x1, u0, l0, u1, l1, s): upper and lower edge, s as for lines."""
    xa, xb = (number(v) for v in canvas.x.range)
    ya, yb = (number(v) for v in canvas.y.range)
    top = canvas.plot_height - 1
    moved = ", ".join(f"case when t0 > 0 then {a} + t0 * ({b} - {a}) else {a} end as c{a}, case when t1 < 1 then {a} + t1 * ({b} - {a}) else {b} end as c{b}" for a, b in (("x0", "x1"), ("u0", "u1"), ("l0", "l1")))
    edge = lambda a, b: (
        f"(case when run = 0 and k = 1 then {b} when k = 0 then {a} else {a} + sign({b} - {a})::int * {bresenham(f'abs({b} - {a})', 'k', 'run', 'pb < pa')} end)"
    )
    lo, hi = f"greatest(0, least({top}, ea))", f"greatest(-1, least({top + 1}, eb))"
    away = f"((ea < 0 and eb <= 0) or (ea > {top} and eb >= {top}))"
    if stacked:
        rows = f"select *, unnest(case when lo <> hi then generate_series(lo, hi - sign(hi - lo)::int, sign(hi - lo)::int) else [] end) as py from clm where not {away}"
    else:
        # the lower edge's pixel is drawn too, if it is on the canvas
        rows = f"select *, unnest(case when lo = hi then [lo] else generate_series(lo, hi, sign(hi - lo)::int) end) as py from clm where not {away}"
    return f"""seg as ({segments}),
ok as (select *, x1 - x0 as dx from seg where x0 is not null and x1 is not null and u0 is not null and u1 is not null and l0 is not null and l1 is not null
       and not least(u0, u1, l0, l1) > {yb} and not greatest(u0, u1, l0, l1) < {ya}),
lim as (select *, greatest(0.0::double, case when dx > 0 then ({xa} - x0) / dx when dx < 0 then ({xb} - x0) / dx end) as t0,
        least(1.0::double, case when dx > 0 then ({xb} - x0) / dx when dx < 0 then ({xa} - x0) / dx end) as t1 from ok where dx <> 0 or x0 between {xa} and {xb}),
cut as (select *, {moved} from lim where t0 <= t1),
pix as (select *, {vertex(canvas.x, 'cx0')} as pa, {vertex(canvas.x, 'cx1')} as pb, {', '.join(f"{vertex(canvas.y, 'c' + c)} as q{c}" for c in ('u0', 'u1', 'l0', 'l1'))} from cut),
dir as (select *, abs(pb - pa) as run from pix),
stp as (select *, unnest(range(case when s or t0 > 0 then 0 else 1 end, case when run = 0 and t0 <= 0 and t1 >= 1 then 2 else run + 1 end)) as k from dir),
edg as (select *, (pa + sign(pb - pa)::int * k)::int as px, {edge('qu0', 'qu1')} as ea, {edge('ql0', 'ql1')} as eb from stp),
clm as (select *, {lo} as lo, {hi} as hi from edg where px between 0 and {canvas.plot_width - 1}),
{name} as (select * exclude (py), py::int as py from ({rows}) where py between 0 and {top})"""


def channels(pixel_: str) -> list[str]:
    return [f"(({pixel_} >> {8 * n}) & 255)" for n in range(4)]


def packed(r: str, g: str, b: str, a: str) -> str:
    """A packed pixel; fractions are truncated."""
    byte = lambda e: f"cast(trunc({e}) as bigint)"
    return f"({byte(r)} | ({byte(g)} << 8) | ({byte(b)} << 16) | ({byte(a)} << 24))"


def composite(src: str, dst: str, how: str) -> str:
    """src onto dst, both packed."""
    if how == "source":
        return f"(case when {channels(src)[3]} > 0 then {src} else {dst} end)"
    s, d = ([f"({c} / 255.0::double)" for c in channels(p)] for p in (src, dst))
    sa, da = s[3], d[3]
    alpha = f"({sa} + {da} * (1 - {sa}))" if how == "over" else f"least(1.0::double, {sa} + {da})"
    first = f"least({sa}, 1 - {da})" if how == "saturate" else sa
    second = f"{da} * (1 - {sa})" if how == "over" else da
    mixed = lambda x, y: f"({f'{first} * {x}' if how == 'saturate' else f'{x} * {first}'} + {f'{y} * {second}'})"
    out = [f"least(1.0::double, coalesce({mixed(x, y)} / nullif({alpha}, 0), 0)) * 255" for x, y in zip(s[:3], d[:3])]
    return packed(*out, f"least(1.0::double, {alpha}) * 255")
