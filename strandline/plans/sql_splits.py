"""SQL of the sequential segmenters, from their definitions: greedy splits as a recursive query, and the methods that combine them.

Each function gives members of a WITH RECURSIVE list. Vectors are relations (seq_id, pos, vec); score maps are relations (seq_id, boundary, score).
"""

from __future__ import annotations

from ..sources import tables as T
from .q_gaps import frame_sql, mean_sql

#: The relations that all queries start from: either model's vectors, and the segments asked for.
BASE = f"""WITH RECURSIVE {T.SQL["vectors"]}, {T.SQL["refs"]}, {T.SQL["sizes"]}, v1 AS (SELECT seq_id, pos, vec[1:32] AS vec FROM vectors), v2 AS (SELECT seq_id, pos, vec[33:64] AS vec FROM vectors),
kk AS (SELECT seq_id, n, (SELECT count(*) FROM refs r WHERE r.seq_id = z.seq_id) + 1 AS k FROM sizes z)"""
UNIT = "list_transform(m, lambda x: x / sqrt(list_dot_product(m, m)))"


def share(frac: float) -> str:
    return f"greatest(2, round_even({frac}::DOUBLE * k, 0))::INT"


def smooth(out: str, src: str, w: int, dim: int = 32) -> str:
    h = w // 2
    return f"{out} AS (SELECT seq_id, pos, {UNIT} AS vec FROM (SELECT seq_id, pos, {mean_sql(frame_sql(-h, h), dim)} AS m FROM {src}))"


def beside(out: str, a: str, b: str) -> str:
    """Both models' vectors side by side, at length one."""
    return f"{out} AS (SELECT seq_id, pos, {UNIT} AS vec FROM (SELECT a.seq_id, a.pos, list_concat(a.vec, b.vec) AS m FROM {a} a JOIN {b} b USING (seq_id, pos)))"


def prefix(out: str, src: str, dim: int) -> str:
    return f"""{out} AS (SELECT seq_id, pos + 1 AS i, list_transform(range(1, {dim + 1}), lambda d: list_sum(list_transform(l, lambda v: v[d]))) AS p FROM (SELECT seq_id, pos, list(vec) OVER (PARTITION BY seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS l FROM {src})
UNION ALL SELECT DISTINCT seq_id, 0, list_transform(range(0, {dim}), lambda d: 0::DOUBLE) FROM {src})"""


LESS = "list_transform(list_zip({a}, {b}), lambda z: z[1] - z[2])"
COSINE = "1 - list_cosine_similarity(" + LESS.format(a="s.p", b="a.p") + ", " + LESS.format(a="e.p", b="s.p") + ")"


def squared(x: str, y: str) -> str:
    d = LESS.format(a=f"{y}.p", b=f"{x}.p")
    return f"list_dot_product({d}, {d}) / ({y}.i - {x}.i)"


#: The fall of squared error of a split: what the halves' sums gain over the whole's, as the squares themselves cancel out.
FALL = f"{squared('a', 's')} + {squared('s', 'e')} - {squared('a', 'e')}"


def splits(out: str, src: str, segments: str, dim: int = 32, least: int = 1, score: str = COSINE) -> str:
    """(seq_id, boundary, score, ord) of the greedy splits in the order made; `segments` is an expression over kk's n and k."""
    return f"""{prefix(f"{out}_p", src, dim)},
{out}_n AS (SELECT seq_id, max(i) AS n, any_value(({segments}) - 1) AS most FROM {out}_p JOIN (SELECT seq_id, n, k FROM kk) USING (seq_id) GROUP BY seq_id),
{out}_r AS (SELECT seq_id, n, most, []::BIGINT[] AS cuts, []::DOUBLE[] AS scores FROM {out}_n
  UNION ALL SELECT seq_id, n, most, list_append(cuts, b.i), list_append(scores, b.x) FROM (
    SELECT r.seq_id, r.n, r.most, r.cuts, r.scores, max_by(struct_pack(i := s.i, x := {score}), {score}) AS b
    FROM (SELECT r.*, g.i AS at, coalesce(list_max(list_filter(cuts, lambda c: c < g.i)), 0) AS lo, coalesce(list_min(list_filter(cuts, lambda c: c > g.i)), n) AS hi FROM {out}_r r JOIN {out}_p g ON g.seq_id = r.seq_id AND g.i > 0 AND g.i < r.n WHERE len(cuts) < most AND NOT list_contains(cuts, g.i)) r
    JOIN {out}_p s ON s.seq_id = r.seq_id AND s.i = r.at JOIN {out}_p a ON a.seq_id = r.seq_id AND a.i = r.lo JOIN {out}_p e ON e.seq_id = r.seq_id AND e.i = r.hi
    WHERE r.at - r.lo >= {least} AND r.hi - r.at >= {least} AND r.hi - r.lo >= 2 * {least} GROUP BY r.seq_id, r.n, r.most, r.cuts, r.scores)),
{out} AS (SELECT seq_id, unnest(cuts) AS boundary, unnest(scores) AS score, unnest(range(1, len(cuts) + 1)) AS ord FROM (SELECT * FROM {out}_r QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY len(cuts) DESC) = 1))"""


def first(out: str, src: str, segments: str) -> str:
    """The first splits of a longer run."""
    return f"{out} AS (SELECT s.* FROM {src} s JOIN kk USING (seq_id) WHERE ord <= ({segments}) - 1)"


def mean_maps(out: str, maps: list[str], weights: list[float] | None = None) -> str:
    """Each map by its largest score; what is missing is 0."""
    weights = weights or [1 / len(maps)] * len(maps)
    parts = " UNION ALL ".join(f"SELECT seq_id, boundary, {w!r}::DOUBLE * score / max(score) OVER (PARTITION BY seq_id) AS x FROM {m}" for m, w in zip(maps, weights, strict=True))
    return f"{out} AS (SELECT seq_id, boundary, sum(x) AS score FROM ({parts}) GROUP BY seq_id, boundary)"


def best(src: str, count: str, columns: str = "seq_id, boundary") -> str:
    """The best boundaries of a map; `count` is an expression over kk's n and k."""
    return f"SELECT {columns} FROM (SELECT m.seq_id, m.boundary, m.score, n, k FROM {src} m JOIN kk USING (seq_id)) QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, boundary) <= ({count})"


def named(name: str, query: str) -> str:
    return f"SELECT seq_id, '{name}' AS method, boundary::BIGINT AS boundary FROM ({query})"


def one_sided(out: str, src: str, w: int, dim: int = 32) -> str:
    f = f"SELECT seq_id, pos, {frame_sql(-w, -1)} AS l, {frame_sql(0, w - 1)} AS r FROM {src}"
    return f"{out} AS (SELECT seq_id, pos AS boundary, 1 - list_cosine_similarity({mean_sql('l', dim)}, {mean_sql('r', dim)}) AS score FROM ({f}) WHERE pos > 0)"


def overlapping(out: str, src: str, w: int = 3, dim: int = 32) -> str:
    f = f"SELECT seq_id, pos, {frame_sql(-1 - w, w - 1)} AS l, {frame_sql(-w, w)} AS r FROM {src}"
    return f"{out} AS (SELECT seq_id, pos AS boundary, 1 - list_cosine_similarity({mean_sql('l', dim)}, {mean_sql('r', dim)}) AS score FROM ({f}) WHERE pos > 0)"


def over_all(out: str, src: str) -> str:
    """Min-max over all gaps, those that a map lacks counting 0."""
    return f"""{out} AS (SELECT seq_id, boundary, CASE WHEN max(s) OVER q > min(s) OVER q THEN (s - min(s) OVER q) / (max(s) OVER q - min(s) OVER q) ELSE 0 END AS score
  FROM (SELECT g.seq_id, g.pos AS boundary, coalesce(m.score, 0) AS s FROM v1 g LEFT JOIN {src} m ON m.seq_id = g.seq_id AND m.boundary = g.pos WHERE g.pos > 0) WINDOW q AS (PARTITION BY seq_id))"""


def halves(out: str, a: str, b: str) -> str:
    return f"{out} AS (SELECT seq_id, boundary, (a.score + b.score) / 2 AS score FROM {a} a JOIN {b} b USING (seq_id, boundary))"


RECENCY = """rec AS (SELECT seq_id, pos AS boundary, 1 - list_cosine_similarity(
  list_transform(range(1, 33), lambda d: list_sum(list_transform(l, lambda v, i: v[d] * exp(-0.5 * (len(l) - i))))), list_transform(range(1, 33), lambda d: list_sum(list_transform(r, lambda v, i: v[d] * exp(-0.5 * (i - 1)))))) AS score
  FROM (SELECT seq_id, pos, list(vec) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS l, list(vec) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS r FROM v1) WHERE pos > 0)"""
DROP = f"""drp AS (SELECT seq_id, pos AS boundary, -list_dot_product({mean_sql("l", 32)}, {mean_sql("r", 32)}) AS score
  FROM (SELECT seq_id, pos, {frame_sql(-3, -1)} AS l, {frame_sql(0, 2)} AS r FROM v1) WHERE pos > 0)"""
POOL = "least(n - 1, 3 * greatest(1, k - 1) + 2)"
CHUNKS = f"""c1 AS (SELECT seq_id, pos // 4 AS pos, {mean_sql("list(vec ORDER BY pos)", 32)} AS vec FROM v1 GROUP BY seq_id, pos // 4)"""


def minimum(out: str, src: str, least: int, scores: str | None = None) -> str:
    """Boundaries (seq_id, boundary) without those that make segments shorter than `least`, dropped one at a time."""
    weaker = "sc[b[i]] < sc[b[i - 1]]" if scores else "false"
    listed = f"SELECT g.seq_id, list(coalesce(s.score, 0)::DOUBLE ORDER BY g.pos) AS sc FROM v1 g LEFT JOIN {scores} s ON s.seq_id = g.seq_id AND s.boundary = g.pos WHERE g.pos > 0 GROUP BY g.seq_id" if scores else "SELECT seq_id, []::DOUBLE[] AS sc FROM sizes"
    lengths = "list_transform(list_zip(list_append(b, n), list_prepend(0, b)), lambda z: z[1] - z[2])"
    return f"""{out}_l AS ({listed}), {out}_s AS (SELECT seq_id, n, list(boundary::BIGINT ORDER BY boundary) AS b, any_value(sc) AS sc FROM {src} JOIN sizes USING (seq_id) JOIN {out}_l USING (seq_id) GROUP BY seq_id, n),
{out}_r AS (SELECT seq_id, n::BIGINT AS n, b, sc, 0 AS step FROM {out}_s
  UNION ALL SELECT seq_id, n, list_concat(b[1:j - 1], b[j + 1:]), sc, step + 1 FROM (
    SELECT *, CASE WHEN i = 1 THEN 1 WHEN i = len(b) + 1 THEN len(b) WHEN {weaker} THEN i ELSE i - 1 END AS j FROM (
      SELECT *, list_position({lengths}, list_min({lengths})) AS i FROM {out}_r WHERE len(b) > 0 AND list_min({lengths}) < {least}))),
{out} AS (SELECT seq_id, unnest(b) AS boundary FROM (SELECT * FROM {out}_r QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY step DESC) = 1))"""


def spaced(src: str, count: str, gap: int) -> str:
    """Greedy choice by score, none closer than `gap` to another."""
    return f"""SELECT seq_id, unnest(list_reduce(list_transform(b, lambda x: [x]), lambda acc, x: CASE WHEN len(acc) < c AND len(list_filter(acc, lambda y: abs(y - x[1]) < {gap})) = 0 THEN list_append(acc, x[1]) ELSE acc END, []::BIGINT[])) AS boundary
FROM (SELECT seq_id, ({count}) AS c, list(boundary::BIGINT ORDER BY score DESC, boundary) AS b FROM {src} JOIN kk USING (seq_id) GROUP BY seq_id, n, k)"""


K7, K75, K8 = share(0.7), share(0.75), share(0.8)
PAIR = f"{BASE}, {smooth('s1', 'v1', 9)}, {smooth('s2', 'v2', 9)}"


def two(name: str, segments: str) -> str:
    """Splits of both models, asked for `segments` but not over all units."""
    return ", ".join(splits(f"{name}{i}", f"s{i}", f"least(n - 1, {segments})") for i in (1, 2))


def around(out: str, cand: str, model: int, reach: int | None = None) -> str:
    """1 - cosine of the means on either side of each candidate: up to its neighbours, or `reach` units."""
    lo = "coalesce(lag(boundary) OVER w, 0)" if reach is None else f"greatest(0, boundary - {reach})"
    hi = "coalesce(lead(boundary) OVER w, n)" if reach is None else f"least(n, boundary + {reach})"
    return f"""{out}_e AS (SELECT seq_id, boundary, {lo} AS lo, {hi} AS hi FROM {cand} JOIN sizes USING (seq_id) WINDOW w AS (PARTITION BY seq_id ORDER BY boundary)),
{out} AS (SELECT x.seq_id, x.boundary, {COSINE} AS score FROM {out}_e x JOIN x{model}_p s ON s.seq_id = x.seq_id AND s.i = x.boundary JOIN x{model}_p a ON a.seq_id = x.seq_id AND a.i = x.lo JOIN x{model}_p e ON e.seq_id = x.seq_id AND e.i = x.hi)"""


def passes(name: str, tag: str, k: str, over: str, multiple: int, w: float, reach: int | None = None) -> tuple[str, str]:
    """Members and query of a second pass over the best candidates of the first."""
    with_ = f"""{first(f"{tag}a", "x1", f"least(n - 1, {over})")}, {first(f"{tag}b", "x2", f"least(n - 1, {over})")}, {mean_maps(f"{tag}f", [f"{tag}a", f"{tag}b"])},
{tag}c AS ({best(f"{tag}f", f"{multiple} * {k}", "seq_id, boundary, score")}), {around(f"{tag}p", f"{tag}c", 1, reach)}, {around(f"{tag}q", f"{tag}c", 2, reach)}, {mean_maps(f"{tag}g", [f"{tag}p", f"{tag}q"])},
{tag}z AS (SELECT seq_id, boundary, {w}::DOUBLE * f.score + (1 - {w}::DOUBLE) * g.score AS score FROM {tag}c f JOIN {tag}g g USING (seq_id, boundary))"""
    return with_, named(name, best(f"{tag}z", k))


def contrast(out: str, cand: str, model: int) -> str:
    """How much better a unit fits the ten units from it on than the ten before it, centred on the median and scaled by the range."""
    f = f"SELECT seq_id, pos, vec, {frame_sql(0, 9)} AS r, {frame_sql(-10, -1)} AS l FROM s{model}"
    return f"""{out} AS (SELECT seq_id, boundary, (x - median(x) OVER q) / greatest(max(x) OVER q - min(x) OVER q, 1e-8) + 0.5 AS score
  FROM (SELECT c.seq_id, c.boundary, list_cosine_similarity(vec, {mean_sql("r", 32)}) - list_cosine_similarity(vec, {mean_sql("l", 32)}) AS x FROM {cand} c JOIN ({f}) f ON f.seq_id = c.seq_id AND f.pos = c.boundary) WINDOW q AS (PARTITION BY seq_id))"""


def iterative() -> str:
    parts = [
        passes("iterative_cross_e5", "ia", K7, "least(k, n - 1) * 3 + 2", 2, 0.5),
        passes("iterative_v2_frac75", "ib", K75, "least(k, n - 1) * 4 + 2", 3, 0.3),
        passes("iterative_fw_e5base", "ic", K7, f"greatest(2 * {K7} + 2, {K7} + 4)", 2, 0.4, 15),
    ]
    last = f"""{first("ida", "x1", f"least(n - 1, 4 * {K7} + 2)")}, {first("idb", "x2", f"least(n - 1, 4 * {K7} + 2)")}, {mean_maps("idf", ["ida", "idb"])}, idc AS ({best("idf", f"2 * {K7}", "seq_id, boundary, score")}),
{contrast("idp", "idc", 1)}, {contrast("idq", "idc", 2)}, idz AS (SELECT seq_id, boundary, 0.4::DOUBLE * f.score + 0.6::DOUBLE * (p.score + q.score) / 2 AS score FROM idc f JOIN idp p USING (seq_id, boundary) JOIN idq q USING (seq_id, boundary))"""
    return f"{PAIR}, {two('x', 'least(k, n - 1) * 4 + 2')}, " + ", ".join(p[0] for p in parts) + f", {last} " + " UNION ALL ".join([*(p[1] for p in parts), named("contrastive_e5base", best("idz", K7))])


def resolutions() -> str:
    maps, members = [], []
    for w in (7, 9, 11):
        for i in (1, 2):
            members += [smooth(f"w{w}_{i}", f"v{i}", w), splits(f"r{w}_{i}", f"w{w}_{i}", f"least(n - 1, 4 * {K7} + 2)")]
            maps.append(f"r{w}_{i}")
    triple = f"{beside('v3', 'v1', 'v2')}, {smooth('s3', 'v3', 9, 64)}, {smooth('s1', 'v1', 9)}, {smooth('s2', 'v2', 9)}, " + ", ".join(splits(f"t{i}", f"s{i}", f"least(n - 1, 4 * {K7} + 2)", 64 if i == 3 else 32) for i in (1, 2, 3))
    return f"{BASE}, {', '.join(members)}, {mean_maps('mr', maps)}, {triple}, {mean_maps('tr', ['t1', 't2', 't3'])} {named('triple_model', best('tr', K7))} UNION ALL {named('multi_res_cross_e5', best('mr', K7))}"


def optimal() -> str:
    """Dynamic programming: a row for each number of segments with the best value and the first best predecessor of each end, then the way back."""
    gain = squared("a", "e")
    return f"""{BASE}, {prefix("p", "v1", 32)}, g AS (SELECT a.seq_id, a.i AS s, e.i AS e, {gain} AS gain FROM p a JOIN p e ON a.seq_id = e.seq_id AND a.i < e.i),
f AS (SELECT seq_id, 0 AS j, list_transform(range(0, n + 1), lambda x: CASE WHEN x = 0 THEN 0 ELSE '-infinity'::DOUBLE END) AS val, []::BIGINT[] AS back FROM kk
  UNION ALL SELECT seq_id, j + 1, list_prepend('-infinity'::DOUBLE, list(v ORDER BY e)), list(b ORDER BY e) FROM (
    SELECT f.seq_id, f.j, g.e, max(f.val[g.s + 1] + g.gain) AS v, arg_max(g.s, (f.val[g.s + 1] + g.gain, -g.s)) AS b FROM f JOIN g USING (seq_id) JOIN kk USING (seq_id) WHERE f.j < least(k, n) GROUP BY f.seq_id, f.j, g.e) GROUP BY seq_id, j),
w AS (SELECT seq_id, least(k, n) AS j, n::BIGINT AS e FROM kk WHERE k >= 2 UNION ALL SELECT w.seq_id, w.j - 1, f.back[w.e] FROM w JOIN f ON f.seq_id = w.seq_id AND f.j = w.j WHERE w.j > 1)
{named("dp", "SELECT seq_id, e AS boundary FROM w JOIN sizes USING (seq_id) WHERE e < n")}"""


DEPTH = f"""dg AS (SELECT seq_id, boundary, score AS g FROM o5), dl AS (SELECT seq_id, list(1 - g ORDER BY boundary) AS s, count(*) AS m FROM dg GROUP BY seq_id),
dk AS (SELECT list(exp(-0.5 * pow(d / 1.5, 2)) ORDER BY d) AS w, sum(exp(-0.5 * pow(d / 1.5, 2))) AS t FROM range(-6, 7) r(d)),
ds AS (SELECT seq_id, i, list_sum(list_transform(range(-6, 7), lambda d: w[d + 7] / t * s[CASE WHEN ((i - 1 + d) % (2 * m) + 2 * m) % (2 * m) < m THEN ((i - 1 + d) % (2 * m) + 2 * m) % (2 * m) ELSE 2 * m - 1 - ((i - 1 + d) % (2 * m) + 2 * m) % (2 * m) END + 1])) AS x
  FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM dl), dk),
db AS (SELECT *, CASE WHEN lag(x) OVER o >= x THEN NULL ELSE i END AS lb, CASE WHEN lead(x) OVER o >= x THEN NULL ELSE i END AS rb FROM ds WINDOW o AS (PARTITION BY seq_id ORDER BY i)),
de AS (SELECT *, max(lb) OVER (PARTITION BY seq_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS lo, min(rb) OVER (PARTITION BY seq_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM db),
dp AS (SELECT e.seq_id, e.i AS boundary, 0.5 * (a.x - e.x) + 0.5 * (b.x - e.x) AS score FROM de e JOIN ds a ON a.seq_id = e.seq_id AND a.i = e.lo JOIN ds b ON b.seq_id = e.seq_id AND b.i = e.hi)"""


def numbers() -> str:
    """Counts of segments chosen by a criterion, by the elbow of split scores, and by the variance of neighbours' similarities."""
    edges = "list_sort(list_concat([0, n], list_filter(list_transform(list_zip(cuts, range(1, len(cuts) + 1)), lambda z: CASE WHEN z[2] < k2 THEN z[1] END), lambda x: x IS NOT NULL)))"
    return f"""{PAIR}, {splits("x", "v1", "greatest(least(30, n // 3) + 1, least(30, n // 4))")}, {smooth("s7", "v1", 7)}, {splits("y", "s7", "least(40, n // 4)")},
xl AS (SELECT seq_id, list(boundary ORDER BY ord) AS cuts FROM x GROUP BY seq_id),
be AS (SELECT seq_id, k2, unnest({edges}[1:len({edges}) - 1]) AS lo, unnest({edges}[2:]) AS hi FROM (SELECT seq_id, n, cuts, unnest(range(2, least(30, n // 4) + 1)) AS k2 FROM xl JOIN sizes USING (seq_id))),
bc AS (SELECT b.seq_id, k2, sum(-list_dot_product({LESS.format(a="e.p", b="a.p")}, {LESS.format(a="e.p", b="a.p")})) + (k2 - 1) * ln(any_value(z.n)) AS cost FROM be b JOIN x_p a ON a.seq_id = b.seq_id AND a.i = b.lo JOIN x_p e ON e.seq_id = b.seq_id AND e.i = b.hi JOIN sizes z ON z.seq_id = b.seq_id GROUP BY b.seq_id, k2),
bk AS (SELECT seq_id, arg_min(k2, (cost, k2)) AS kb FROM bc GROUP BY seq_id),
el AS (SELECT seq_id, row_number() OVER w AS i, lead(score) OVER w - 2 * score + lag(score) OVER w AS d FROM x JOIN sizes USING (seq_id) WHERE ord <= least(30, n // 3) WINDOW w AS (PARTITION BY seq_id ORDER BY score DESC)),
ek AS (SELECT seq_id, greatest(2, least(arg_min(i, (d, i)) + 1, least(30, any_value(n) // 3))) AS ke FROM el JOIN sizes USING (seq_id) WHERE d IS NOT NULL GROUP BY seq_id),
nr AS (SELECT a.seq_id, b.pos AS g, list_dot_product(a.vec, b.vec) AS s FROM s7 a JOIN s7 b ON a.seq_id = b.seq_id AND b.pos = a.pos + 1),
nv AS (SELECT nr.seq_id, k2, var_pop(s) AS v FROM nr JOIN (SELECT seq_id, n, unnest(range(2, least(40, n // 4) + 1)) AS k2 FROM sizes) z USING (seq_id) LEFT JOIN y ON y.seq_id = nr.seq_id AND y.boundary = nr.g AND y.ord < k2 WHERE y.ord IS NULL GROUP BY nr.seq_id, k2),
nd AS (SELECT seq_id, k2 - 1 AS e, v - lag(v) OVER (PARTITION BY seq_id ORDER BY k2) AS d FROM nv), vk AS (SELECT seq_id, greatest(2, least(arg_min(e, (d, e)), any_value(n) // 4)) AS kv FROM nd JOIN sizes USING (seq_id) WHERE d IS NOT NULL GROUP BY seq_id),
{splits("x1", "s1", "n - 1")}, {splits("x2", "s2", "n - 1")}, f1 AS (SELECT x1.* FROM x1 JOIN vk USING (seq_id) JOIN sizes USING (seq_id) WHERE ord <= least(3 * kv, n - 1) - 1), f2 AS (SELECT x2.* FROM x2 JOIN vk USING (seq_id) JOIN sizes USING (seq_id) WHERE ord <= least(3 * kv, n - 1) - 1), {mean_maps("fm", ["f1", "f2"])}
{named("divisive_bic", "SELECT seq_id, boundary FROM x JOIN bk USING (seq_id) WHERE ord <= kb - 1")} UNION ALL {named("divisive_elbow", "SELECT seq_id, boundary FROM x JOIN ek USING (seq_id) WHERE ord <= ke - 1")} UNION ALL
{named("cross_e5_gapvar", "SELECT seq_id, boundary FROM fm JOIN vk USING (seq_id) QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, boundary) <= kv")}"""


def keyed(counted, names: str = "h", refs: str = "rr", sizes: str = "zz") -> str:
    """The members of pk and wd over sequences whose id holds a method too."""
    return counted(names, refs).replace("FROM sizes LEFT JOIN", f"FROM {sizes} LEFT JOIN")


def battery() -> str:
    """All methods of the battery as one relation of hypotheses, and their metrics."""
    from .q_metrics import BS, LISTS, counted, f1_sql

    inner = optimal().split(f"{BASE}, ", 1)[1]
    dp_members, dp_query = inner[: inner.index("SELECT seq_id, 'dp'")].rstrip(), inner[inner.index("SELECT seq_id, 'dp'") :]
    it_members, it_query = passes("iterative_cross_e5", "ia", K7, "least(k, n - 1) * 3 + 2", 2, 0.5)
    cos = "cs AS (SELECT seq_id, boundary, max(1 - score) OVER (o ROWS UNBOUNDED PRECEDING) + max(1 - score) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 2 * (1 - score) AS score FROM og WINDOW o AS (PARTITION BY seq_id ORDER BY boundary))"
    hyp = " UNION ALL ".join([
        named("cosine", best("cs", "k - 1")), named("divisive", f"{ROWS} ba"), named("divisive_smooth9", f"{ROWS} bb"), dp_query, named("treeseg", f"{ROWS} bc"), named("depth", best("dp", "k - 1")), named("cross_e5_frac70", f"{ROWS} cb"),
        named("cross_e5_frac70_minlen10", f"{ROWS} cm"), it_query, named("hierarchical", best("og", "least(greatest(2, round_even(0.3::DOUBLE * k, 0)), k) - 1")),
    ])
    methods = "['cosine', 'divisive', 'divisive_smooth9', 'dp', 'treeseg', 'depth', 'cross_e5_frac70', 'cross_e5_frac70_minlen10', 'iterative_cross_e5', 'hierarchical']"
    swap = lambda x: x.replace("FROM hyp h", "FROM h h").replace("FROM refs r", "FROM rr r").replace("FROM sizes z", "FROM zz z").replace("LEFT JOIN refs r", "LEFT JOIN rr r").replace("FROM refs h LEFT JOIN hyp r", "FROM rr h LEFT JOIN h r")
    return f"""{PAIR}, {splits("ba", "v1", "k")}, {splits("bb", "s1", "k")}, {splits("bc", "v1", "k", 32, 2, FALL)}, {dp_members}, {one_sided("o5", "v1", 5)}, {DEPTH}, {overlapping("og", "v1")}, {cos},
{two("x", f"greatest(4 * {K7} + 2, least(k, n - 1) * 3 + 2)")}, {first("ca1", "x1", f"least(n - 1, 4 * {K7} + 2)")}, {first("ca2", "x2", f"least(n - 1, 4 * {K7} + 2)")}, {mean_maps("cam", ["ca1", "ca2"])}, cb AS ({best("cam", K7)}), {minimum("cm", "cb", 10)}, {it_members},
every AS ({hyp}), h AS (SELECT seq_id::VARCHAR || ':' || method AS seq_id, boundary FROM every), ms AS (SELECT seq_id, n, unnest({methods}) AS method FROM sizes), zz AS (SELECT seq_id::VARCHAR || ':' || method AS seq_id, n FROM ms),
rr AS (SELECT ms.seq_id::VARCHAR || ':' || method AS seq_id, boundary FROM refs JOIN ms USING (seq_id)), {keyed(counted)}, {swap(BS)}, {swap(LISTS)}, {f1_sql(2, "2")}
SELECT split_part(seq_id, ':', 2) AS method, count(*) AS n, round(avg(pk), 6) + 0.0 AS pk, round(avg(wd), 6) + 0.0 AS wd, round(avg(bs), 6) + 0.0 AS bs, round(avg(CASE WHEN f2.p + f2.r > 0 THEN 2 * f2.p * f2.r / (f2.p + f2.r) ELSE 0 END), 6) + 0.0 AS f1
FROM m JOIN bs USING (seq_id) JOIN f2 USING (seq_id) GROUP BY 1"""


def tiles() -> str:
    words = "regexp_extract_all(lower(text), '([a-z'']+)', 1)"
    return f"""{T.with_("units")}, s AS (SELECT seq_id, pos, {words} AS w FROM units), z AS (SELECT seq_id, flatten(list(w ORDER BY pos)) AS w, len(flatten(list(w ORDER BY pos))) AS t, count(*) AS n FROM s GROUP BY seq_id),
y AS (SELECT *, least(20, greatest(3, t // 10)) AS b FROM z), x AS (SELECT *, greatest(1, t // b) AS m, least(10, greatest(2, greatest(1, t // b) // 3)) AS k FROM y WHERE n >= 3),
c AS (SELECT seq_id, least(i // b, m - 1) AS g, term, m, k, count(*) AS c FROM (SELECT seq_id, b, m, k, unnest(w) AS term, unnest(range(0, t)) AS i FROM x WHERE m >= 3) GROUP BY ALL),
l AS (SELECT seq_id, g, term, sum(c) AS c FROM (SELECT seq_id, term, c, m, unnest(range(g + 1, g + k + 1)) AS g FROM c) WHERE g < m GROUP BY ALL), r AS (SELECT seq_id, g, term, sum(c) AS c FROM (SELECT seq_id, term, c, unnest(range(g - k + 1, g + 1)) AS g FROM c) WHERE g > 0 GROUP BY ALL),
d AS (SELECT l.seq_id, l.g, sum(l.c * r.c) AS d FROM l JOIN r USING (seq_id, g, term) GROUP BY 1, 2), nl AS (SELECT seq_id, g, sqrt(sum(c * c)) AS a FROM l GROUP BY 1, 2), nr AS (SELECT seq_id, g, sqrt(sum(c * c)) AS b FROM r GROUP BY 1, 2),
q AS (SELECT seq_id, g, round(coalesce(d, 0) / (a * b), 9) AS s FROM nl JOIN nr USING (seq_id, g) LEFT JOIN d USING (seq_id, g)),
e AS (SELECT seq_id, g, max(s) OVER (o ROWS UNBOUNDED PRECEDING) + max(s) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 2 * s AS d FROM q WINDOW o AS (PARTITION BY seq_id ORDER BY g)),
f AS (SELECT seq_id, g, round(coalesce((lag(d) OVER o + d + lead(d) OVER o) / 3, d), 9) AS x FROM e WINDOW o AS (PARTITION BY seq_id ORDER BY g)),
h AS (SELECT seq_id, g FROM f WINDOW o AS (PARTITION BY seq_id ORDER BY g) QUALIFY x > 0 AND x >= lag(x) OVER o AND x > lead(x) OVER o),
u AS (SELECT seq_id, pos, sum(len(w)) OVER (PARTITION BY seq_id ORDER BY pos) AS e FROM s)
SELECT DISTINCT seq_id, 'texttiling' AS method, boundary FROM (SELECT h.seq_id, h.g, any_value(n) AS n, min(u.pos)::BIGINT AS boundary FROM h JOIN x USING (seq_id) JOIN u ON u.seq_id = h.seq_id AND u.e >= least(h.g * b, t) GROUP BY h.seq_id, h.g) WHERE boundary > 0 AND boundary < n"""


def overlaps() -> str:
    """Greedy matches of segments in the order of prediction, each with the best free reference."""
    from .q_metrics import BASE as METRICS

    seg = lambda n, src: f"{n} AS (SELECT seq_id, list(struct_pack(i := o, s := start, e := fin) ORDER BY o) AS l FROM (SELECT seq_id, start::BIGINT AS start, coalesce(lead(start) OVER w, n)::BIGINT AS fin, row_number() OVER w AS o FROM (SELECT seq_id, boundary AS start FROM {src} UNION SELECT seq_id, 0 FROM sizes) JOIN sizes USING (seq_id) WINDOW w AS (PARTITION BY seq_id ORDER BY start)) GROUP BY seq_id)"
    iou = "greatest(0, least(r.e, x[2]) - greatest(r.s, x[1])) / (greatest(r.e, x[2]) - least(r.s, x[1]))"
    free = f"list_sort(list_transform(list_filter(rl, lambda r: NOT list_contains(acc, r.i)), lambda r: struct_pack(x := -({iou}), i := r.i)))[1]"
    tp = lambda t: f"len(list_reduce(list_transform(pl, lambda p: [p.s, p.e]), lambda acc, x: CASE WHEN coalesce(-({free}).x >= {t}::DOUBLE, false) THEN list_append(acc, ({free}).i) ELSE acc END, []::BIGINT[]))"
    each = " UNION ALL ".join(f"SELECT seq_id, {t}::DOUBLE AS threshold, round(2 * {tp(t)} / (len(pl) + len(rl)), 6) + 0.0 AS f1 FROM b" for t in (0.3, 0.5, 0.7))
    return f"{METRICS}, {seg('ps', 'hyp')}, {seg('rs', 'refs')}, b AS (SELECT p.seq_id, p.l AS pl, r.l AS rl FROM ps p JOIN rs r USING (seq_id)) {each}"


def grid() -> str:
    from .q_metrics import BASE as METRICS
    from .q_metrics import counted

    parts, rows = [], []
    for i, k in enumerate((3, 6, 9, 12)):
        parts.append(f"h{i} AS (SELECT seq_id, boundary FROM one QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, boundary) <= {k}), {counted(f'h{i}', 'refs', f'_{i}')}")
        rows.append(f"SELECT {i}::BIGINT AS point, {k}::BIGINT AS k, count(*) AS n, round(avg(pk), 6) + 0.0 AS pk, round(avg(wd), 6) + 0.0 AS wd FROM m_{i}")
    return f"{METRICS}, {', '.join(parts)} {' UNION ALL '.join(rows)}"


def shortest(scored: bool) -> str:
    from .q_gaps import ONE

    dense = "dn AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, boundary) <= 16)"
    return f"{BASE}, {ONE}, {dense}, {minimum('mf', 'dn', 4, 'dn' if scored else None)} SELECT seq_id, boundary FROM mf"


ROWS = "SELECT seq_id, boundary FROM"
SQL = {
    "divisive": f"{BASE}, {splits('x', 'v1', 'k')} {named('divisive', f'{ROWS} x')}",
    "divisive_constrained": f"{BASE}, {splits('x', 'vectors', '8', 64, 5)} SELECT seq_id, boundary::BIGINT AS boundary FROM x",
    "treeseg": f"{BASE}, {splits('x', 'v1', 'k', 32, 2, FALL)} {named('treeseg', f'{ROWS} x')}",
    "ensemble": f"{BASE}, {splits('x', 'v1', POOL)}, {DROP}, {over_all('a', 'x')}, {over_all('b', 'drp')}, {halves('h', 'a', 'b')} {named('ensemble', best('h', 'greatest(1, k - 1)') + ' AND k >= 2')}",
    "recency": f"{BASE}, {splits('x', 'v1', POOL)}, {RECENCY}, {over_all('a', 'x')}, {over_all('b', 'rec')}, {halves('h', 'a', 'b')} {named('recency', best('rec', 'greatest(1, k - 1)') + ' AND k >= 2')} UNION ALL {named('divisive_recency', best('h', 'greatest(1, k - 1)') + ' AND k >= 2')}",
    "chunked": f"{BASE}, {CHUNKS}, {splits('x', 'c1', 'k')}, {overlapping('o', 'c1')} {named('divisive_chunked', 'SELECT DISTINCT seq_id, greatest(1, least(n - 1, 4 * boundary)) AS boundary FROM x JOIN sizes USING (seq_id)')} UNION ALL "
    + named("two_stage_chunked", f"SELECT DISTINCT seq_id, greatest(1, least(n - 1, 4 * boundary)) AS boundary FROM ({best('o', 'k - 1')}) JOIN sizes USING (seq_id)"),
    "conservative_frac": f"{BASE}, {smooth('s1', 'v1', 9)}, {splits('x', 'v1', 'greatest(2, k - 2)')}, {splits('y', 's1', 'k')} {named('divisive_conservative', f'{ROWS} x')} UNION ALL {named('divisive_smooth9_frac70', f'{ROWS} y JOIN kk USING (seq_id) WHERE ord <= {K7} - 1')} UNION ALL {named('divisive_smooth9_consv3', f'{ROWS} y JOIN kk USING (seq_id) WHERE ord <= greatest(2, k - 3) - 1')}",
    "concat_space": f"{PAIR}, {beside('s3', 's1', 's2')}, {splits('x', 's3', K7, 64)} {named('concat_e5_frac70', f'{ROWS} x')}",
    "combined_depth": f"{PAIR}, {one_sided('a', 's1', 7)}, {one_sided('b', 's2', 7)}, {mean_maps('m', ['a', 'b'])} {named('cross_e5_combined_depth', best('m', K7))}",
    "cross_model": f"{PAIR}, {two('x', f'greatest(6 * {K7} + 2, 4 * {K8} + 2, 10, round_even(3 * k, 0)::INT)')}, "
    + ", ".join(f"{first(f'{t}1', 'x1', f'least(n - 1, {o})')}, {first(f'{t}2', 'x2', f'least(n - 1, {o})')}, {mean_maps(f'{t}m', [f'{t}1', f'{t}2'])}" for t, o in (("a", f"4 * {K8} + 2"), ("b", f"4 * {K75} + 2"), ("c", f"6 * {K7} + 2"), ("d", "greatest(10, round_even(3 * k, 0)::INT)")))
    + f" {named('cross_model_e5large', best('am', K8))} UNION ALL {named('cross_e5_frac75', best('bm', K75))} UNION ALL {named('cross_e5_nms10', spaced('cm', K7, 10))} UNION ALL "
    + named("cross_e5_thresh60", best("(SELECT seq_id, boundary, score, count(*) FILTER (score >= 0.6::DOUBLE * top) OVER (PARTITION BY seq_id) AS many FROM (SELECT *, max(score) OVER (PARTITION BY seq_id) AS top FROM dm))", "greatest(2, least(many, round_even(1.5 * k, 0), n - 1))").replace("m.score, n, k", "m.score, many, n, k")),
    "triple_model": resolutions(),
    "iterative": iterative(),
    "constrained_vote": f"{PAIR}, {splits('x1', 's1', K7, 32, 10)}, {splits('x2', 's2', K7, 32, 10)}, vt AS (SELECT seq_id, boundary, sum(w) AS score FROM (SELECT seq_id, boundary, 2 AS w FROM x1 UNION ALL SELECT seq_id, boundary, 1 FROM x2) GROUP BY 1, 2), vb AS ({best('vt', f'2 * {K7}')}), {minimum('vm', 'vb', 10)} "
    + named("cross_e5_constrained_minlen10", f"SELECT seq_id, boundary FROM (SELECT vm.*, {K7} AS c FROM vm JOIN kk USING (seq_id)) QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY boundary) <= c"),
    "dp_optimal": optimal(),
    "depth_embeddings": f"{BASE}, {one_sided('o5', 'v1', 5)}, {DEPTH} {named('depth', best('dp', 'k - 1'))}",
    "k_selection": numbers(),
    "texttiling": tiles(),
    "segment_f1": overlaps(),
    "grid_search": grid(),
    "min_segment_filter": shortest(False),
    "score_aware_min_segment": shortest(True),
    "evaluation_battery": battery(),
}
