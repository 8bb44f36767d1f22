"""DuckDB SQL for the registered queries."""

from __future__ import annotations


def _b4(x: str, n: int) -> str:
    return " || ".join(f"substr('ACGT', CAST(CAST(floor(({x}) / {4**i}) AS BIGINT) % 4 AS INT) + 1, 1)" for i in range(n))


_U = "(o_orderkey * 7) % 4093"
_ALN = f"""
te AS (SELECT p_partkey AS te_id, 'chr' || CAST(p_partkey % 5 + 1 AS VARCHAR) AS chrom, CAST(floor(p_partkey / 5) AS BIGINT) * 100 AS ts, CAST(floor(p_partkey / 5) AS BIGINT) * 100 + 20 + p_size * 3 AS te,
  replace(p_brand, 'Brand#', 'TE') || '#' || p_type AS feature, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part WHERE p_type <> 'PROMO'),
raw AS (SELECT o_orderkey * 1000 + l_linenumber * 10 + k AS aid, 'r' || CAST(o_orderkey AS VARCHAR) || '_' || CAST(k AS VARCHAR) AS qname, 'chr' || CAST(part % 5 + 1 AS VARCHAR) AS chrom,
  CAST(floor(part / 5) AS BIGINT) * 100 + (supp * 7) % 60 AS s, l_linenumber AS ln, CASE WHEN flag = 'R' THEN '-' ELSE '+' END AS strand,
  CASE WHEN o_orderkey % 97 = 0 THEN '-' WHEN o_orderkey % 101 = 0 THEN '' ELSE {_b4("(o_custkey % 32) * 2003", 8)} END AS cb,
  CASE WHEN o_orderkey % 89 = 0 THEN 'N' || substr(u, 2, 5) ELSE u END AS umi
 FROM (SELECT *, {_b4(f"{_U} + CASE WHEN k = 5 THEN (CASE WHEN ({_U}) % 4 = 3 THEN -3 ELSE 1 END) ELSE 0 END", 6)} AS u FROM
  (SELECT l.*, o_orderkey, o_custkey, unnest(range(0, CAST(o_orderkey % 6 AS INT) + 1)) AS k FROM
   (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(l_suppkey) AS supp, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL) l JOIN orders ON l_orderkey = o_orderkey)))
"""
_VALID = "valid AS (SELECT * FROM raw WHERE cb NOT IN ('', '-') AND umi NOT LIKE '%N%' AND NOT regexp_matches(umi, '^$|^(A+|G+|T+|C+)$'))"
_VALID_NO_UMI = "valid AS (SELECT * REPLACE (qname AS umi) FROM raw WHERE cb NOT IN ('', '-'))"


def _hit(on: str = "", having: str = "") -> str:
    return f"""
blk AS (SELECT aid, cb, umi, qname, chrom, strand, ln, s AS bs, s + 30 AS be FROM valid UNION ALL SELECT aid, cb, umi, qname, chrom, strand, ln, s + 60, s + 90 FROM valid WHERE ln % 2 = 0),
hit AS (SELECT aid, cb, umi, qname AS read, te_id, feature, CAST(sum(least(be, te) - greatest(bs, ts)) AS BIGINT) AS ov
 FROM blk b JOIN te t ON b.chrom = t.chrom AND bs < te AND ts < be {on} GROUP BY aid, cb, umi, qname, te_id, feature, ln {having})"""


_RF = "rf AS (SELECT cb, umi, read, list_sort(list(DISTINCT feature)) AS fs FROM hit GROUP BY ALL)"
_MAP = "maps AS (SELECT cb, umi, fs, CAST(count(*) AS INT) AS n FROM rf GROUP BY ALL)"
_EC = "ec AS (SELECT cb, umi, fs, n, CAST(row_number() OVER (PARTITION BY cb ORDER BY umi, array_to_string(fs, ',')) - 1 AS INT) AS i FROM maps)"
_EDGE = "edge AS (SELECT a.cb, a.i AS src, b.i AS dst FROM ec a JOIN ec b ON a.cb = b.cb AND a.i <> b.i AND hamming(a.umi, b.umi) <= 1 AND a.n >= 2 * b.n - 1 AND len(list_intersect(a.fs, b.fs)) > 0)"
_COMP = """link AS (SELECT cb, src, dst FROM edge UNION SELECT cb, dst, src FROM edge),
walk AS (SELECT cb, i AS n0, i AS m FROM ec UNION SELECT walk.cb, n0, dst FROM walk JOIN link ON walk.cb = link.cb AND m = src),
comp AS (SELECT cb, n0 AS i, CAST(min(m) AS INT) AS c FROM walk GROUP BY ALL)"""
_UNIT = """csize AS (SELECT cb, c, count(*) AS size FROM comp GROUP BY ALL),
member AS (SELECT ec.*, c, size, EXISTS (SELECT 1 FROM edge WHERE edge.cb = ec.cb AND dst = i) AS entered FROM ec JOIN comp USING (cb, i) JOIN csize USING (cb, c) WHERE size <= 2)"""
# The covers of components of several classes, one for each start: `used` are the nodes taken so far and `own` their roots, `front` those
# whose successors come next; without any, the first free node becomes a root. The first cover with the fewest roots counts.
_COVER = """grp AS (SELECT cb, c, list(i ORDER BY i) AS nodes, list(fs ORDER BY i) AS nfs FROM ec JOIN comp USING (cb, i) GROUP BY cb, c HAVING count(*) > 1),
lnk AS (SELECT edge.cb, c, list({'s': src, 'd': dst}) AS es FROM edge JOIN comp ON comp.cb = edge.cb AND comp.i = src GROUP BY edge.cb, c),
net AS (SELECT *, list_filter(nodes, lambda x: NOT list_contains(list_transform(es, lambda e: e.d), x)) AS st FROM grp JOIN lnk USING (cb, c)),
cover AS (SELECT cb, c, s, s AS root, [s] AS used, [s] AS own, [s] AS front FROM (SELECT cb, c, unnest(CASE WHEN len(st) > 0 THEN st ELSE nodes END) AS s FROM net)
 UNION ALL SELECT cb, c, s, CASE WHEN len(front) = 0 THEN rest[1] ELSE root END, used || add, own || list_transform(add, lambda x: CASE WHEN len(front) = 0 THEN rest[1] ELSE root END), add
 FROM (SELECT *, CASE WHEN len(front) = 0 THEN rest[1:1] ELSE list_distinct(list_transform(list_filter(es, lambda e: list_contains(front, e.s) AND NOT list_contains(used, e.d)
    AND len(list_intersect(nfs[list_position(nodes, e.d)], nfs[list_position(nodes, root)])) > 0), lambda e: e.d)) END AS add
  FROM (SELECT cover.*, nodes, nfs, es, list_filter(nodes, lambda x: NOT list_contains(used, x)) AS rest FROM cover JOIN net USING (cb, c)) WHERE len(front) > 0 OR len(rest) > 0)),
pick AS (SELECT * FROM cover JOIN net USING (cb, c) WHERE len(front) = 0 AND len(used) = len(nodes) QUALIFY row_number() OVER (PARTITION BY cb, c ORDER BY len(list_distinct(own)), s) = 1),
unit AS (SELECT cb, i AS root, fs FROM ec JOIN comp USING (cb, i) WHERE (cb, c) NOT IN (SELECT (cb, c) FROM grp)
 UNION ALL SELECT cb, root, CASE WHEN len(st) > 0 THEN nfs[list_position(nodes, root)] ELSE list_sort(list_distinct(flatten(nfs))) END FROM (SELECT * EXCLUDE (root), unnest(list_distinct(own)) AS root FROM pick))"""
# Shares of u(cb, fs) until the log-likelihood gains less than 1e-4, 100 cycles at most; `settled` has each cell's last cycle.
_SETTLE = """sets AS (SELECT cb, fs, count(*) AS wt, row_number() OVER () AS r FROM u WHERE len(fs) > 1 GROUP BY cb, fs),
m AS (SELECT cb, r, wt, unnest(fs) AS f FROM sets),
ft AS (SELECT cb, f, CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY cb) AS p FROM (SELECT DISTINCT cb, f FROM m)),
ll0 AS (SELECT cb, sum(wt * ln(s + 2.220446049250313e-16)) AS ll FROM (SELECT m.cb, m.r, any_value(wt) AS wt, sum(p) AS s FROM m JOIN ft USING (cb, f) GROUP BY m.cb, m.r) GROUP BY cb),
em AS (SELECT cb, f, p, 0 AS k, ll, CAST('inf' AS DOUBLE) AS gain FROM ft JOIN ll0 USING (cb)
 UNION ALL SELECT * FROM (WITH cur AS (SELECT m.cb, m.r, wt, m.f, em.p, k, ll, sum(em.p) OVER (PARTITION BY m.cb, m.r) AS s FROM m JOIN em ON m.cb = em.cb AND m.f = em.f WHERE k < 100 AND gain >= 1e-4),
  nxt AS (SELECT cb, f, sum(wt * p / s) / sum(sum(wt * p / s)) OVER (PARTITION BY cb) AS p, k + 1 AS k, ll FROM cur GROUP BY cb, f, k, ll),
  lln AS (SELECT cb, sum(wt * ln(s + 2.220446049250313e-16)) AS ll2 FROM (SELECT m.cb, m.r, any_value(wt) AS wt, sum(nxt.p) AS s FROM m JOIN nxt ON m.cb = nxt.cb AND m.f = nxt.f GROUP BY m.cb, m.r) GROUP BY cb)
  SELECT nxt.cb, f, p, CAST(k AS INT), ll2, abs(ll2 - ll) FROM nxt JOIN lln USING (cb))),
settled AS (SELECT * FROM em QUALIFY k = max(k) OVER (PARTITION BY cb))"""
_NOUMI = [_ALN, _VALID_NO_UMI, _hit(), _RF, "u AS (SELECT cb, read AS u, fs FROM rf)"]


def _q(body: str, *parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(parts)} {body}"


def _em(k: int, body: str, *more: str) -> str:
    """Shares after k cycles as table p, in no-UMI mode."""
    parts = [
        *_NOUMI,
        "m AS (SELECT cb, u, unnest(fs) AS f FROM u WHERE len(fs) > 1)",
        "p0 AS (SELECT cb, f, 1.0 / count(*) OVER (PARTITION BY cb) AS p FROM (SELECT DISTINCT cb, f FROM m))",
    ]
    for c in range(1, k + 1):
        parts += [
            f"r{c} AS (SELECT m.cb, m.u, m.f, p / sum(p) OVER (PARTITION BY m.cb, m.u) AS w FROM m JOIN p{c - 1} USING (cb, f))",
            f"p{c} AS (SELECT cb, f, sum(w) / sum(sum(w)) OVER (PARTITION BY cb) AS p FROM r{c} GROUP BY cb, f)",
        ]
    return _q(body.replace("{p}", f"p{k}"), *parts, *more)


_BASE = [_ALN, _VALID, _hit()]
_TO_MAP = [*_BASE, _RF, _MAP]
_TO_EC = [*_TO_MAP, _EC]
_HITS = "SELECT aid, cb, umi, read, te_id, feature, ov FROM hit"
_FEATURES = "SELECT CAST(row_number() OVER (ORDER BY feature_id) AS INT) AS feature_idx, feature_id, {name} AS feature_name, 'Gene Expression' AS feature_type FROM (SELECT DISTINCT unnest(fs) AS feature_id FROM maps)"
_LOCI = """loci AS (SELECT p_partkey AS te_id, 'chr' || CAST(p_partkey % 5 + 1 AS VARCHAR) AS chrom, CAST(floor(p_partkey / 5) AS BIGINT) * 100 AS "start", CAST(floor(p_partkey / 5) AS BIGINT) * 100 + 20 + p_size * 3 AS "end",
  replace(p_brand, 'Brand#', 'TE') || '#' || p_type || '/F' AS name, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part WHERE p_type <> 'PROMO'),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY name ORDER BY te_id) AS INT) AS locus_index FROM loci)"""
_WHITE = f"white AS (SELECT {_b4('i * 3 * 2003', 8)} AS cb FROM range(10) r(i))"

# counts per cell and feature from the shares {p}
_COUNTS = """SELECT cb, feature_id, CAST(sum(c) AS DOUBLE) AS c FROM (SELECT cb, fs[1] AS feature_id, 1.0 AS c FROM u WHERE len(fs) = 1
  UNION ALL SELECT q.cb, f, p * n FROM {p} q JOIN (SELECT cb, count(*) AS n FROM u WHERE len(fs) > 1 GROUP BY cb) USING (cb)) GROUP BY ALL"""

_NAMED = """bar AS (SELECT cb, CAST(row_number() OVER (ORDER BY cb) AS INT) AS bi FROM (SELECT DISTINCT cb FROM maps)),
feat AS (SELECT f, CAST(row_number() OVER (ORDER BY f) AS INT) AS fi FROM (SELECT DISTINCT unnest(fs) AS f FROM maps))"""
_FINAL = "final AS (" + _COUNTS.format(p="settled") + ")"
_MATRIX = """SELECT fi AS feature_idx, bi AS barcode_idx, round_even(c, 3) AS "count" FROM final JOIN bar USING (cb) JOIN feat ON f = feature_id WHERE c >= 0.001"""
_HEADER = "SELECT (SELECT count(*) FROM feat) AS n_features, (SELECT count(*) FROM bar) AS n_barcodes, (SELECT count(*) FROM final WHERE c >= 0.001) AS nnz"
_STATS = "SELECT DISTINCT cb, k AS cycles, gain < 1e-4 AS converged, round_even(ll, 3) AS loglik, round_even(gain, 6) AS increment FROM settled"
_U_UMI = "u AS (SELECT cb, fs FROM unit)"
_LOCUS_TE = [_ALN.replace("te AS (", "te0 AS (", 1), _LOCI, """te AS (SELECT te_id, chrom, "start" AS ts, "end" AS te, name || '~' || CAST(locus_index AS VARCHAR) AS feature, strand FROM numbered)"""]
_TO_UNIT = [_EC, _EDGE, _COMP, _COVER]
_TO_COUNT = [*_TO_UNIT, _U_UMI, _SETTLE, _NAMED, _FINAL]
_NO_UMI_COUNT = [*_NOUMI, _MAP, _SETTLE, _NAMED, _FINAL]

ORACLES: dict[str, str] = {
    "valid_alignments": _q("SELECT aid, cb, umi, qname AS read, chrom, strand FROM valid", _ALN, _VALID),
    "valid_alignments_no_umi": _q("SELECT aid, cb, umi, qname AS read, chrom, strand FROM valid", _ALN, _VALID_NO_UMI),
    "whitelist_semi": _q("SELECT aid, cb, umi FROM valid SEMI JOIN white USING (cb)", _ALN, _VALID, _WHITE),
    "chrom_missing_anti": _q("SELECT DISTINCT chrom FROM raw WHERE chrom NOT IN (SELECT chrom FROM te WHERE chrom <> 'chr3')", _ALN),
    "chrom_common_semi": _q("SELECT DISTINCT chrom FROM raw WHERE chrom IN (SELECT chrom FROM te WHERE chrom <> 'chr3')", _ALN),
    "tag_check": _q("SELECT true AS has_tags FROM (SELECT 1 FROM raw WHERE cb <> '' AND umi <> '' LIMIT 1)", _ALN),
    "chrom_mapped_counts": _q("SELECT chrom, count(*) AS n FROM raw GROUP BY chrom", _ALN),
    "annotation_subfamilies": f'WITH {_LOCI} SELECT te_id, chrom, "start", "end", name AS feature, locus_index, strand FROM numbered',
    "annotation_loci": f"""WITH {_LOCI} SELECT te_id, chrom, "start", "end", name || '~' || CAST(locus_index AS VARCHAR) AS feature, locus_index, strand FROM numbered""",
    "overlap_hits": _q(_HITS, *_BASE),
    "overlap_hits_forward": _q(_HITS, _ALN, _VALID, _hit("AND b.strand = t.strand")),
    "overlap_hits_reverse": _q(_HITS, _ALN, _VALID, _hit("AND b.strand <> t.strand")),
    "overlap_hits_min_bp": _q(_HITS, _ALN, _VALID, _hit(having="HAVING sum(least(be, te) - greatest(bs, ts)) >= 20")),
    "overlap_hits_min_fraction": _q(_HITS, _ALN, _VALID, _hit(having="HAVING sum(least(be, te) - greatest(bs, ts)) >= 0.5 * CASE WHEN ln % 2 = 0 THEN 60 ELSE 30 END")),
    "overlap_hits_whitelist": _q(_HITS + " SEMI JOIN white USING (cb)", *_BASE, _WHITE),
    "read_feature_sets": _q("SELECT cb, umi, read, array_to_string(fs, ',') AS features FROM rf", *_BASE, _RF),
    "mappings": _q("SELECT cb, umi, array_to_string(fs, ',') AS features, n AS read_count FROM maps", *_TO_MAP),
    "mappings_no_umi": _q("SELECT cb, umi, array_to_string(fs, ',') AS features, n AS read_count FROM maps", _ALN, _VALID_NO_UMI, _hit(), _RF, _MAP),
    "barcode_index": _q("SELECT CAST(row_number() OVER (ORDER BY cb) AS INT) AS barcode_idx, cb FROM (SELECT DISTINCT cb FROM maps)", *_TO_MAP),
    "feature_index": _q(_FEATURES.format(name="regexp_replace(feature_id, '#.+', '')"), *_TO_MAP),
    "feature_index_locus": _q(
        _FEATURES.format(name="regexp_replace(feature_id, '#[^~]+', '')"),
        _ALN.replace("te AS (", "te0 AS (", 1), _LOCI, """te AS (SELECT te_id, chrom, "start" AS ts, "end" AS te, name || '~' || CAST(locus_index AS VARCHAR) AS feature, strand FROM numbered)""", _VALID, _hit(), _RF, _MAP,
    ),
    "ec_index": _q("SELECT cb, i AS ec_index, umi, array_to_string(fs, ',') AS features, n AS read_count FROM ec", *_TO_EC),
    "umi_candidate_pairs": _q("SELECT a.cb, a.i, b.i AS j FROM ec a JOIN ec b ON a.cb = b.cb AND a.i < b.i AND hamming(a.umi, b.umi) <= 1", *_TO_EC),
    "umi_edges": _q("SELECT cb, src, dst FROM edge", *_TO_EC, _EDGE),
    "umi_components": _q("SELECT cb, i AS ec_index, c AS component FROM comp", *_TO_EC, _EDGE, _COMP, recursive=True),
    "umi_parents": _q("SELECT cb, i AS ec_index FROM ec WHERE NOT EXISTS (SELECT 1 FROM edge WHERE edge.cb = ec.cb AND dst = i)", *_TO_EC, _EDGE),
    # of one class: itself; of two: one parent takes the other in; two mutual ones: the first, with the features of both
    "umi_units_small": _q(
        """SELECT cb, i AS root, size, array_to_string(fs, ',') AS features FROM member WHERE NOT entered
        UNION ALL SELECT cb, i, size, (SELECT array_to_string(list_sort(list_distinct(flatten(list(o.fs)))), ',') FROM member o WHERE o.cb = m.cb AND o.c = m.c) FROM member m
        WHERE size = 2 AND i = c AND NOT EXISTS (SELECT 1 FROM member o WHERE o.cb = m.cb AND o.c = m.c AND NOT o.entered)""",
        *_TO_EC, _EDGE, _COMP, _UNIT, recursive=True,
    ),
    "umi_units": _q("SELECT cb, root AS unit_id, root, array_to_string(fs, ',') AS features FROM unit", *_TO_MAP, *_TO_UNIT, recursive=True),
    "ec_dump": _q(
        """SELECT bi AS Barcode_id, ec.cb AS Barcode, ec.i AS EqClass, ec.umi AS UMI, array_to_string(ec.fs, ',') AS Features, ec.n AS Read_count, coalesce(r.umi, '') AS Dedup_UMI, coalesce(array_to_string(unit.fs, ','), '') AS Dedup_feature
        FROM ec JOIN bar USING (cb) LEFT JOIN (SELECT cb, unnest(used) AS i, unnest(own) AS root FROM pick) o ON o.cb = ec.cb AND o.i = ec.i AND o.root <> ec.i
        LEFT JOIN ec r ON r.cb = ec.cb AND r.i = o.root LEFT JOIN unit ON unit.cb = ec.cb AND unit.root = o.root""",
        *_TO_MAP, *_TO_UNIT, _NAMED, recursive=True,
    ),
    "counts_umi": _q(_MATRIX, *_TO_MAP, *_TO_COUNT, recursive=True),
    "counts_locus": _q(_MATRIX, *_LOCUS_TE, _VALID, _hit(), _RF, _MAP, *_TO_COUNT, recursive=True),
    "counts_no_umi": _q(_MATRIX, *_NO_UMI_COUNT, recursive=True),
    "em_stats": _q(_STATS, *_TO_MAP, *_TO_COUNT, recursive=True),
    "em_stats_no_umi": _q(_STATS, *_NO_UMI_COUNT, recursive=True),
    "counts_no_umi_dataflow": _q('SELECT cb, feature_id, round_even(c, 3) AS "count" FROM final WHERE c >= 0.001', *_NO_UMI_COUNT, recursive=True),
    "matrix_header": _q(_HEADER, *_TO_MAP, *_TO_COUNT, recursive=True),
    "matrix_header_no_umi": _q(_HEADER, *_NO_UMI_COUNT, recursive=True),
    "unique_counts_no_umi": _q('SELECT cb, fs[1] AS feature_id, CAST(count(*) AS DOUBLE) AS "count" FROM u WHERE len(fs) = 1 GROUP BY ALL', *_NOUMI),
    "em_one_step": _em(1, "SELECT cb, f AS feature_id, floor(CAST(p AS DOUBLE) * 1e9 + 0.5001) / 1e9 AS p FROM {p}"),
    "em_fixed5": _em(5, "SELECT cb, f AS feature_id, floor(CAST(p AS DOUBLE) * 1e9 + 0.5001) / 1e9 AS p FROM {p}"),
    "em_loglik": _em(1, "SELECT cb, round_even(CAST(sum(ln(s + 2.220446049250313e-16)) AS DOUBLE), 3) AS loglik FROM (SELECT m.cb, m.u, sum(p) AS s FROM m JOIN {p} USING (cb, f) GROUP BY m.cb, m.u) GROUP BY cb"),
    "counts_no_umi_k5": _em(5, f'SELECT cb, feature_id, round_even(c, 3) AS "count" FROM ({_COUNTS}) WHERE c >= 0.001'),
    "counts_no_umi_kernel_k5": _em(5, f'SELECT cb, feature_id, round_even(c, 3) AS "count" FROM ({_COUNTS}) WHERE c >= 0.001'),
    "ec_dump_no_umi": _q(
        """SELECT bi AS Barcode_id, cb AS Barcode, i AS EqClass, umi AS Read_name, array_to_string(fs, ',') AS Features, n AS Read_count
        FROM ec JOIN (SELECT cb, CAST(row_number() OVER (ORDER BY cb) AS INT) AS bi FROM (SELECT DISTINCT cb FROM maps)) USING (cb)""",
        *_NOUMI[:-1], _MAP, _EC,
    ),
    "matrix_header_no_umi_k5": _em(5, f"""SELECT (SELECT count(DISTINCT f) FROM (SELECT unnest(fs) AS f FROM u)) AS n_features, (SELECT count(DISTINCT cb) FROM u) AS n_barcodes,
        (SELECT count(*) FROM ({_COUNTS}) WHERE c >= 0.001) AS nnz"""),
}
