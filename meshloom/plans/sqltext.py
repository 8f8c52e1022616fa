"""SQL of the derived meshes and of the partitioning steps, as WITH clauses for oracle queries."""

from __future__ import annotations

from ..functions.elements import FACES
from ..functions.geometry import HEXA_TETS

_CORNERS = ", ".join(f"1 + (i + {a}) + 11 * ((j + {b}) + 11 * (k + {c})) AS c{n}" for n, (a, b, c) in enumerate(((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))))


def _quad(*at: int) -> str:
    return "[" + ", ".join(f"c{i}" for i in at) + "]"


def faces_sql(nodes: str = "nodes", code: str = "elem_type") -> str:
    case = " ".join(f"WHEN {t} THEN [" + ", ".join("[" + ", ".join(f"{nodes}[{i + 1}]" for i in f) + "]" for f in fs) + "]" for t, fs in FACES.items())
    return f"CASE {code} {case} END"


MESH = f"""
p AS (SELECT p_partkey AS p, p_partkey % 10 AS i, (p_partkey // 10) % 10 AS j, p_partkey // 100 AS k, p_size % 2 = 1 AS solid FROM part),
g AS (SELECT max(p) + 1 AS n, (max(p) + 1) // 100 AS nz FROM p),
c AS (SELECT p.*, g.*, {_CORNERS} FROM p, g),
nodes AS (SELECT node_id, i + ((node_id * 7919) % 16) / 256.0::DOUBLE AS x, j + ((node_id * 7919 + 5) % 16) / 256.0::DOUBLE AS y, k + ((node_id * 7919 + 11) % 16) / 256.0::DOUBLE AS z
  FROM (SELECT 1 + i + 11 * (j + 11 * k) AS node_id, i, j, k FROM range(11) a(i), range(11) b(j), (SELECT unnest(range(nz + 1)) AS k FROM g))),
elements AS (
  SELECT CASE WHEN solid THEN 2 ELSE 1 END AS section_id, p + 1 AS elem_id, 17 AS elem_type, {_quad(*range(8))} AS nodes FROM c
  UNION ALL SELECT 3, n + 1 + i + 10 * j, 7, {_quad(0, 3, 2, 1)} FROM c WHERE k = 0
  UNION ALL SELECT 4, n + 101 + i + 10 * j, 7, {_quad(4, 5, 6, 7)} FROM c WHERE k = nz - 1
  UNION ALL SELECT 5, n + 201 + (k * 4 + 0) * 10 + i, 7, {_quad(0, 1, 5, 4)} FROM c WHERE j = 0
  UNION ALL SELECT 5, n + 201 + (k * 4 + 1) * 10 + j, 7, {_quad(1, 2, 6, 5)} FROM c WHERE i = 9
  UNION ALL SELECT 5, n + 201 + (k * 4 + 2) * 10 + i, 7, {_quad(2, 3, 7, 6)} FROM c WHERE j = 9
  UNION ALL SELECT 5, n + 201 + (k * 4 + 3) * 10 + j, 7, {_quad(0, 4, 7, 3)} FROM c WHERE i = 0
  UNION ALL SELECT 6, n + 201 + 40 * nz + j + 10 * k, 7, {_quad(0, 4, 7, 3)} FROM c WHERE i = 5),
names(section_id, name) AS (VALUES (1, 'FLUID_a'), (2, 'SOLID_b'), (3, 'INLET'), (4, 'OUTLET'), (5, 'WALL'), (6, 'INTERIOR_mid')),
sections AS (SELECT section_id, name, min(elem_type) AS elem_type, min(elem_id) AS "start", max(elem_id) AS "end", 0 AS n_bdy, count(*) AS n_elem FROM elements JOIN names USING (section_id) GROUP BY section_id, name),
mixed AS (
  SELECT p * 6 + 1 AS elem_id, 17 AS elem_type, {_quad(*range(8))} AS nodes FROM c WHERE (i + 10 * j) % 7 != 3 AND p % 5 != 1
  {"".join(f"UNION ALL SELECT p * 6 + {m}, 14, {_quad(*f)} FROM c WHERE (i + 10 * j) % 7 = 3 " for m, f in ((1, (0, 1, 2, 4, 5, 6)), (2, (0, 2, 3, 4, 6, 7))))}
  {"".join(f"UNION ALL SELECT p * 6 + {m + 1}, 12, [{', '.join(f'c{x}' for x in f)}, 100000 + p] FROM c WHERE (i + 10 * j) % 7 != 3 AND p % 5 = 1 " for m, f in enumerate(FACES[17]))}),
mnodes AS (SELECT * FROM nodes UNION ALL SELECT 100000 + p, i + 0.5::DOUBLE, j + 0.5::DOUBLE, k + 0.5::DOUBLE FROM c WHERE (i + 10 * j) % 7 != 3 AND p % 5 = 1),
tets AS ({" UNION ALL ".join(f"SELECT p * 6 + {m + 1} AS elem_id, 10 AS elem_type, {_quad(*t)} AS nodes FROM c" for m, t in enumerate(((0, 1, 2, 6), (0, 1, 5, 6), (0, 3, 2, 6), (0, 3, 7, 6), (0, 4, 5, 6), (0, 4, 7, 6))))}),
"""

# -- vectors as SQL text: a point is (x, y, z) of expressions ------------------------------------


def _p(i: int) -> tuple[str, str, str]:
    return (f"x{i}", f"y{i}", f"z{i}")


def _op(a, b, o):
    return tuple(f"({x} {o} {y})" for x, y in zip(a, b, strict=True))


def _scale(a, s, o="*"):
    return tuple(f"({x} {o} {s})" for x in a)


def _mean(ps):
    out = ps[0]
    for q in ps[1:]:
        out = _op(out, q, "+")
    return _scale(out, f"{len(ps)}.0::DOUBLE", "/")


def _cross(a, b):
    return (f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})")


def _dot(a, b):
    return f"({a[0]} * {b[0]} + {a[1]} * {b[1]} + {a[2]} * {b[2]})"


def _area(a, b, c):
    n = _cross(_op(b, a, "-"), _op(c, a, "-"))
    return f"(sqrt({_dot(n, n)}) / 2.0::DOUBLE)"


def _quad_center(ps):
    s, t = _area(ps[0], ps[1], ps[2]), _area(ps[0], ps[2], ps[3])
    both = _op(_scale(_mean([ps[0], ps[1], ps[2]]), s), _scale(_mean([ps[0], ps[2], ps[3]]), t), "+")
    return _scale(both, f"({s} + {t})", "/")


def _hexa_center(ps):
    total, out = [], None
    for t in HEXA_TETS:
        a, b, c, d = (ps[i] for i in t)
        v = f"(abs({_dot(_op(a, d, '-'), _cross(_op(b, d, '-'), _op(c, d, '-')))}) / 6.0::DOUBLE)"
        part = _scale(_mean([a, b, c, d]), v)
        out = part if out is None else _op(out, part, "+")
        total.append(v)
    return _scale(out, "(" + " + ".join(total) + ")", "/")


def _pyra_center(ps):
    base = _quad_center(ps[:4])
    return _op(base, _scale(_op(ps[4], base, "-"), "3.0::DOUBLE", "/"), "+")


def center_columns() -> str:
    ps = [_p(i) for i in range(8)]
    forms = {5: _mean(ps[:3]), 7: _quad_center(ps), 10: _mean(ps[:4]), 12: _pyra_center(ps), 14: _scale(_op(_mean(ps[:3]), _mean(ps[3:6]), "+"), "2.0::DOUBLE", "/"), 17: _hexa_center(ps)}
    return ", ".join(f"CASE elem_type {' '.join(f'WHEN {t} THEN {f[k]}' for t, f in forms.items())} END AS {a}" for k, a in enumerate("xyz"))


def centers_of(cells: str, nodes: str, name: str) -> str:
    """WITH clauses: `name`(elem_id, elem_type, x, y, z) for the elements of `cells`."""
    wide = ", ".join(f"max({a}) FILTER (pos = {i}) AS {a}{i}" for i in range(8) for a in "xyz")
    return f"""
{name}_e AS (SELECT elem_id, elem_type, unnest(nodes) AS node_id, unnest(range(len(nodes))) AS pos FROM {cells}),
{name}_w AS MATERIALIZED (SELECT elem_id, elem_type, {wide} FROM {name}_e JOIN {nodes} USING (node_id) GROUP BY elem_id, elem_type),
{name} AS MATERIALIZED (SELECT elem_id, elem_type, {center_columns()} FROM {name}_w),
"""


CUT = f"""
body AS (SELECT * FROM elements WHERE section_id IN (1, 2)),
{centers_of("body", "nodes", "ctr")}
bb AS (SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM nodes),
cp AS MATERIALIZED (SELECT elem_id, CAST((z >= min_z + (max_z - min_z) * 0.5) AS INT) * 4 + CAST((x >= min_x + (max_x - min_x) * 0.5) AS INT) * 2 + CAST((y >= min_y + (max_y - min_y) * 0.5) AS INT) AS part_id FROM ctr, bb),
pc AS MATERIALIZED (SELECT part_id, section_id, elem_id, elem_type, nodes FROM body JOIN cp USING (elem_id)),
pf AS (SELECT part_id, elem_id, unnest({faces_sql()}) AS face_nodes, unnest(range(6)) AS face_no FROM pc),
outerf AS MATERIALIZED (SELECT part_id, array_to_string(list_sort(face_nodes), '-') AS face_key, arg_max(face_nodes, elem_id * 8 + face_no) AS face_nodes FROM pf GROUP BY part_id, array_to_string(list_sort(face_nodes), '-') HAVING count(*) % 2 = 1),
bdy AS (SELECT section_id, elem_id, array_to_string(list_sort(nodes), '-') AS face_key, nodes FROM elements WHERE section_id IN (3, 4, 5)),
bounded AS MATERIALIZED (SELECT * FROM (SELECT part_id, section_id, elem_id, face_key, nodes, row_number() OVER (PARTITION BY part_id, face_key ORDER BY section_id, elem_id) AS r FROM outerf JOIN bdy USING (face_key)) WHERE r = 1),
openf AS MATERIALIZED (SELECT * FROM outerf o WHERE NOT EXISTS (SELECT 1 FROM bounded b WHERE b.part_id = o.part_id AND b.face_key = o.face_key)),
iface AS MATERIALIZED (SELECT a.part_id, b.part_id AS nbr_id, a.face_key, a.face_nodes FROM openf a JOIN openf b ON a.face_key = b.face_key AND a.part_id != b.part_id),
pn AS MATERIALIZED (SELECT DISTINCT part_id, unnest(nodes) AS node_id FROM pc),
loc AS MATERIALIZED (SELECT part_id, node_id, row_number() OVER (PARTITION BY part_id ORDER BY node_id) AS local_id FROM pn),
inner_e AS (SELECT section_id, elem_id, len(nodes) AS n, unnest(nodes) AS node_id FROM elements WHERE section_id = 6),
inter AS (SELECT part_id, section_id, elem_id FROM inner_e JOIN pn USING (node_id) GROUP BY part_id, section_id, elem_id, n HAVING count(DISTINCT node_id) = n),
sizes AS (SELECT part_id, section_id AS write_seq, section_id, count(*) AS n FROM (SELECT part_id, section_id FROM pc UNION ALL SELECT part_id, section_id FROM bounded UNION ALL SELECT part_id, section_id FROM inter UNION ALL SELECT part_id, nbr_id + 1000 FROM iface) GROUP BY part_id, section_id),
"""


def sql(select: str, cut: bool = False) -> str:
    """An oracle: the mesh's clauses (and the cut's), then `select`, which may begin with clauses of its own
    ended by a line `---`."""
    extra, sep, last = select.rpartition("---")
    head = "WITH " + MESH + (CUT if cut else "") + (extra.strip().rstrip(",") + "," if sep else "")
    return head + "zz AS (SELECT 1 AS one)\n" + (last if sep else select).strip()
