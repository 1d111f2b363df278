"""The registered queries in SQL, over the same tables.

Directions and offsets of projections are written into the text as numbers,
drawn as the indexes draw them.
"""

from __future__ import annotations

import re

from vecspark.functions.text import MAX_RESIDUES, NUMBER
from vecspark.operators import index
from vecspark.plans import queries as q
from vecspark.plans import search

DIM = 64
BASE = f"""x AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q AS (SELECT vec_id AS query_id, label AS qlabel, v AS qv FROM x WHERE vec_id % {q.STEP} = 0)"""
WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _list(values) -> str:
    return "[" + ", ".join(repr(float(x)) for x in values) + "]::DOUBLE[]"


def _hash(direction, offset, width) -> str:
    return f"CAST(floor((list_inner_product(v, {_list(direction)}) + {float(offset)!r}) / {float(width)!r}) AS BIGINT)"


def _ranked(candidates: str, k: int, name: str = "") -> str:
    """CTEs that rank (query_id, vec_id) of ``candidates`` by distance: r{name}."""
    return f"""d{name} AS (SELECT c.query_id, c.vec_id AS neighbor_id, round(list_distance(q.qv, x.v), 4) AS l2_dist
  FROM ({candidates}) c JOIN q ON c.query_id = q.query_id JOIN x ON c.vec_id = x.vec_id),
r{name} AS (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY l2_dist, neighbor_id) AS INTEGER) AS rank, neighbor_id, l2_dist FROM d{name}) WHERE rank <= {k})"""


EVERYTHING = "SELECT q.query_id, x.vec_id FROM q, x"


def _lsh(params: index.LshParams) -> str:
    """CTEs post and probe of an index with whole keys."""
    directions, offsets = index.LshIndex(params).draws(DIM)
    tables = []
    for t in range(params.L):
        key = " || ',' || ".join(f"CAST({_hash(a, b, params.w)} AS VARCHAR)" for a, b in zip(directions[t], offsets[t], strict=True))
        tables.append(f"SELECT vec_id, '{t}:' || {key} AS bucket FROM x")
    return "post AS (" + " UNION ALL ".join(tables) + f"),\nprobe AS (SELECT vec_id AS query_id, bucket FROM post WHERE vec_id % {q.STEP} = 0)"


JOINED = "SELECT DISTINCT probe.query_id, post.vec_id FROM probe JOIN post ON probe.bucket = post.bucket"


def _lsh_compat(params: index.LshParams) -> str:
    directions, offsets = index.LshIndex(params).draws(DIM)
    prime, posts, probes = index.PRIME, [], []
    for t in range(params.L):
        hashes = [_hash(a, b, params.w) for a, b in zip(directions[t], offsets[t], strict=True)]
        value = hashes[0]
        for h in hashes[1:]:
            value = f"({h} - CASE WHEN {value} < 0 THEN 25 ELSE 0 END)"
        posts.append(f"SELECT vec_id, '{t}:' || CAST((({value}) % {prime} + {prime}) % {prime} AS VARCHAR) AS bucket FROM x")
        probes.append(f"SELECT vec_id AS query_id, '{t}:' || CAST((({hashes[-1]}) % {prime} + {prime}) % {prime} AS VARCHAR) AS bucket FROM x WHERE vec_id % {q.STEP} = 0")
    return "post AS (" + " UNION ALL ".join(posts) + "),\nprobe AS (" + " UNION ALL ".join(probes) + ")"


def _cube(params: index.HypercubeParams) -> str:
    """CTEs vert (vec_id, bucket), opened (query_id, bucket, probe_rank) and cube (query_id, vec_id)."""
    directions, offsets = index.HypercubeIndex(params).draws(DIM)
    vertex = "0::BIGINT"
    for j, (a, b) in enumerate(zip(directions, offsets, strict=True)):
        digest = f"md5('{params.seed}:{j}:' || CAST({_hash(a, b, params.w)} AS VARCHAR))"
        vertex = f"(({vertex}) * 2 + CASE WHEN substr({digest}, 1, 1) >= '8' THEN 1 ELSE 0 END)"
    masks = ", ".join(f"({i}, {m}::BIGINT)" for i, m in enumerate(index.probe_masks(params.kproj, params.probes)))
    return f"""vert AS (SELECT vec_id, CAST({vertex} AS BIGINT) AS bucket FROM x),
opened AS (SELECT vec_id AS query_id, xor(bucket, mask) AS bucket, CAST(i AS INTEGER) AS probe_rank FROM vert, (VALUES {masks}) m(i, mask) WHERE vec_id % {q.STEP} = 0),
cube AS (SELECT query_id, vec_id FROM (
  SELECT o.query_id, p.vec_id, row_number() OVER (PARTITION BY o.query_id ORDER BY o.probe_rank, p.vec_id) AS n FROM opened o JOIN vert p ON o.bucket = p.bucket) WHERE n <= {params.M})"""


CENTROIDS = """comp AS (SELECT label, vec_id, unnest(v) AS e, generate_subscripts(v, 1) AS p FROM x),
mean AS (SELECT label AS cluster_id, p, avg(e) AS e, count(*) AS n FROM comp GROUP BY ALL),
cent AS (SELECT cluster_id, list(e ORDER BY p) AS c, max(n) AS n FROM mean GROUP BY cluster_id),
near AS (SELECT vec_id, cluster_id, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(v, c), cluster_id) AS probe_rank FROM x, cent),
lists AS (SELECT vec_id, cluster_id AS bucket FROM near WHERE probe_rank = 1)"""
FLAT = f"""probes AS (SELECT vec_id AS query_id, cluster_id AS bucket, probe_rank FROM near WHERE vec_id % {q.STEP} = 0 AND probe_rank <= {q.NPROBE})"""
OPENED = "SELECT DISTINCT p.query_id, l.vec_id FROM probes p JOIN lists l ON p.bucket = l.bucket"
SIZE = DIM // q.PARTS
BOOKS = f"""parts AS (SELECT CAST(unnest(range({q.PARTS})) AS INTEGER) AS part),
drawn AS (SELECT vec_id, v FROM x ORDER BY md5('{q.SEED}:' || CAST(vec_id AS VARCHAR)), vec_id LIMIT {q.WORDS}),
books AS (SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS INTEGER) AS code, v[part * {SIZE} + 1 : (part + 1) * {SIZE}] AS word FROM drawn, parts),
codes AS (SELECT vec_id, part, code FROM (
  SELECT x.vec_id, b.part, b.code, row_number() OVER (PARTITION BY x.vec_id, b.part ORDER BY round(list_distance(v[b.part * {SIZE} + 1 : (b.part + 1) * {SIZE}], word), 9), b.code) AS n FROM x, books b) WHERE n = 1),
dt AS (SELECT query_id, b.part, b.code, pow(list_distance(qv[b.part * {SIZE} + 1 : (b.part + 1) * {SIZE}], word), 2) AS t FROM q, books b)"""
ADC = f"""adcs AS (SELECT o.query_id, o.vec_id, round(sum(dt.t), 6) AS adc FROM ({OPENED}) o JOIN codes c ON o.vec_id = c.vec_id
  JOIN dt ON dt.query_id = o.query_id AND dt.part = c.part AND dt.code = c.code GROUP BY o.query_id, o.vec_id),
best AS (SELECT query_id, vec_id, adc FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY adc, vec_id) AS n FROM adcs) WHERE n <= {q.K})"""
HITS = """hits AS (
  SELECT qseqid, sseqid, pident, 100 - 10 * d AS bitscore, d * d AS evalue, sseqid AS line_no FROM (
    SELECT query_id AS qseqid, vec_id AS sseqid, round(list_distance(qv, v), 4) AS d,
           list_sum(list_transform(list_zip(qv, v), lambda z: CASE WHEN (z[1] >= 0) = (z[2] >= 0) THEN 1 ELSE 0 END)) * 100.0 / len(qv) AS pident
    FROM q JOIN x ON qlabel = label))"""
TRUTH = f"""ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY qseqid ORDER BY bitscore DESC, line_no) AS INTEGER) AS rank FROM hits),
truth AS (SELECT qseqid AS query_id, rank, sseqid AS neighbor_id FROM ranked WHERE rank <= {q.N})"""


def _methods() -> str:
    return ",\n".join((
        BASE, _lsh(q.LSH), _cube(q.CUBE), CENTROIDS, FLAT,
        _ranked(EVERYTHING, q.N, "_e"), _ranked("SELECT * FROM cube", q.N, "_c"), _ranked(OPENED, q.N, "_f"), _ranked(JOINED, q.N, "_l"),
        "answers AS (SELECT 1 AS position, 'exact' AS method, * FROM r_e UNION ALL SELECT 2, 'hypercube', * FROM r_c UNION ALL SELECT 3, 'ivfflat', * FROM r_f UNION ALL SELECT 4, 'lsh', * FROM r_l)",
        HITS, TRUTH,
    ))


def _sweep() -> str:
    """The recall of each configuration of the sweep."""
    parts, rows = [BASE, HITS, TRUTH], []
    for i, config in enumerate(search.configurations(q.SWEEP)):
        named = lambda text, i=i: re.sub(r"\b(post|probe)\b", rf"\g<1>_{i}", text)
        parts += [named(_lsh(index.LshParams(**(search.GRID_DEFAULTS["lsh"] | config)))), _ranked(named(JOINED), q.N, f"_{i}")]
        shared = f"(SELECT count(*) FROM r_{i} a JOIN truth t ON a.query_id = t.query_id AND a.neighbor_id = t.neighbor_id WHERE a.query_id = q.query_id)"
        columns = ", ".join(f"'{v}' AS param_{k}" for k, v in config.items())
        rows.append(f"SELECT 'lsh' AS method, {q.N} AS recall_n, round(avg({shared} / CAST({q.N} AS DOUBLE)), 6) AS avg_recall, {columns} FROM q")
    return _with(*parts) + " UNION ALL ".join(rows)


def _figures() -> str:
    return _methods() + f""",
names AS (SELECT * FROM (VALUES (1, 'exact'), (2, 'hypercube'), (3, 'ivfflat'), (4, 'lsh')) n(position, method)),
figures AS (
  SELECT q.query_id, n.method, (q.query_id + 1) * n.position * CAST(0.001 AS DOUBLE) AS time_per_query_s,
         (SELECT count(*) FROM answers a JOIN truth t ON a.query_id = t.query_id AND a.neighbor_id = t.neighbor_id
          WHERE a.query_id = q.query_id AND a.method = n.method AND a.rank <= {q.N}) / CAST({q.N} AS DOUBLE) AS recall_at_n
  FROM q, names n)"""


def _annotated() -> str:
    return _methods() + """,
near_by AS (
  SELECT a.*, h.pident AS blast_identity_pct, t.neighbor_id IS NOT NULL AS in_blast_top_n
  FROM answers a LEFT JOIN hits h ON h.qseqid = a.query_id AND h.sseqid = a.neighbor_id
  LEFT JOIN truth t ON t.query_id = a.query_id AND t.neighbor_id = a.neighbor_id)"""


def _lloyd(steps: int) -> str:
    out = [BASE, f"c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cluster_id, v AS c FROM x ORDER BY vec_id LIMIT {q.LLOYD_K})"]
    for s in range(steps):
        out.append(f"""a{s} AS (SELECT vec_id, cluster_id FROM (SELECT vec_id, cluster_id, row_number() OVER (PARTITION BY vec_id ORDER BY round(pow(list_distance(v, c), 2), 10), cluster_id) AS n FROM x, c{s}) WHERE n = 1),
m{s} AS (SELECT cluster_id, list(e ORDER BY p) AS c FROM (SELECT cluster_id, p, avg(e) AS e FROM (SELECT a{s}.cluster_id, unnest(v) AS e, generate_subscripts(v, 1) AS p FROM x JOIN a{s} ON x.vec_id = a{s}.vec_id) GROUP BY ALL) GROUP BY cluster_id),
c{s + 1} AS (SELECT c{s}.cluster_id, coalesce(m{s}.c, c{s}.c) AS c FROM c{s} LEFT JOIN m{s} ON c{s}.cluster_id = m{s}.cluster_id)""")
    return "WITH " + ",\n".join(out) + f""" SELECT vec_id, CAST(cluster_id AS INTEGER) AS cluster_id FROM (
  SELECT vec_id, cluster_id, row_number() OVER (PARTITION BY vec_id ORDER BY round(pow(list_distance(v, c), 2), 10), cluster_id) AS n FROM x, c{steps}) WHERE n = 1"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def oracle_sql() -> dict[str, str]:
    neighbors = "SELECT query_id, rank, neighbor_id, l2_dist FROM r"
    letters = "regexp_replace(text, '[^A-Za-z]+', '', 'g')"
    columns = "method, query_id, rank, neighbor_id, l2_dist, blast_identity_pct, in_blast_top_n"
    kmers = "list_distinct(list_transform(range(1, greatest(len(s) - 4, 1)), lambda i: substr(s, CAST(i AS BIGINT), 6)))"
    out = {
        "exact_knn": _with(BASE, _ranked(EVERYTHING, q.K)) + neighbors,
        "exact_knn_other": _with(BASE, _ranked(EVERYTHING + " WHERE q.query_id <> x.vec_id", q.K)) + neighbors,
        "exact_knn_fallback": _with(BASE, _lsh(q.NARROW), _ranked(JOINED, q.N, "_a"), _ranked(EVERYTHING, q.N, "_e"), f"enough AS (SELECT query_id FROM r_a GROUP BY query_id HAVING count(*) >= {q.N})")
        + "SELECT * FROM r_a WHERE query_id IN (SELECT query_id FROM enough) UNION ALL SELECT * FROM r_e WHERE query_id NOT IN (SELECT query_id FROM enough)",
        "vector_norms": _with(BASE) + "SELECT vec_id, round(sqrt(list_inner_product(v, v)), 4) AS norm FROM x",
        "label_centroids": _with(BASE, CENTROIDS) + "SELECT cluster_id, n, CAST(p - 1 AS INTEGER) AS p, round(e, 8) AS x FROM mean",
        "l2_to_centroids": _with(BASE, CENTROIDS) + "SELECT vec_id, cluster_id, round(list_distance(v, c), 4) AS l2_dist FROM x, cent",
        "ivf_assign": _with(BASE, CENTROIDS) + "SELECT vec_id, bucket AS cluster_id FROM lists",
        "ivf_lists_histogram": _with(BASE, CENTROIDS) + "SELECT bucket AS cluster_id, count(*) AS n FROM lists GROUP BY bucket",
        "ivf_probes": _with(BASE, CENTROIDS, FLAT) + "SELECT query_id, bucket AS cluster_id, CAST(probe_rank AS INTEGER) AS probe_rank FROM probes",
        "ivf_flat_search": _with(BASE, CENTROIDS, FLAT, _ranked(OPENED, q.K)) + neighbors,
        "lloyd_step": _lloyd(1),
        "kmeans_lloyd": _lloyd(3),
        "lsh_buckets": _with(BASE, _lsh(q.LSH)) + "SELECT vec_id, bucket FROM post",
        "lsh_bucket_sizes": _with(BASE, _lsh(q.LSH)) + "SELECT bucket, count(*) AS n FROM post GROUP BY bucket",
        "lsh_search": _with(BASE, _lsh(q.LSH), _ranked(JOINED, q.K)) + neighbors,
        "lsh_key_compat": _with(BASE, _lsh_compat(q.COMPAT), _ranked(JOINED, q.K)) + neighbors,
        "hypercube_vertices": _with(BASE, _cube(q.CUBE)) + "SELECT vec_id, bucket FROM vert",
        "hypercube_probes": _with(BASE, _cube(q.CUBE)) + "SELECT query_id, bucket, probe_rank FROM opened",
        "hypercube_search": _with(BASE, _cube(q.CUBE), _ranked("SELECT * FROM cube", q.K)) + neighbors,
        "pq_encode": _with(BASE, BOOKS) + "SELECT vec_id, part, code FROM codes",
        "pq_distance_table": _with(BASE, BOOKS) + "SELECT query_id, part, code, round(t, 6) AS t FROM dt",
        "pq_adc": _with(BASE, CENTROIDS, FLAT, BOOKS, ADC) + "SELECT query_id, vec_id, adc FROM best",
        "ivf_pq_search": _with(BASE, CENTROIDS, FLAT, BOOKS, ADC, _ranked("SELECT query_id, vec_id FROM best", q.K)) + neighbors,
        "sub_vectors": _with(BASE, f"parts AS (SELECT CAST(unnest(range({q.PARTS})) AS INTEGER) AS part)")
        + f"SELECT vec_id, part, round(list_inner_product(v[part * {SIZE} + 1 : (part + 1) * {SIZE}], v[part * {SIZE} + 1 : (part + 1) * {SIZE}]), 6) AS power FROM x, parts",
        "hit_ranking": _with(BASE, HITS, TRUTH) + f"SELECT qseqid, rank, sseqid, round(bitscore, 4) AS bitscore FROM ranked WHERE rank <= {q.N}",
        "best_hit_per_subject": _with(BASE, HITS) + "SELECT qseqid, sseqid, pident, round(bitscore, 4) AS bitscore FROM hits",
        "evalue_filter": _with(BASE, HITS) + "SELECT qseqid, count(*) AS n FROM hits WHERE evalue <= 1.5 GROUP BY qseqid",
        "printed_union": "WITH " + _methods() + f" SELECT DISTINCT query_id, neighbor_id FROM answers WHERE rank <= {q.K}",
        "restricted_hits": _with(BASE, HITS, _ranked(EVERYTHING, q.K)) + "SELECT qseqid, sseqid, pident FROM hits WHERE sseqid IN (SELECT neighbor_id FROM r)",
        "recall_at_n": "WITH " + _figures() + " SELECT query_id, method, round(recall_at_n, 6) AS recall_at_n FROM figures",
        "method_summary": "WITH " + _figures() + """ SELECT method, round(avg(time_per_query_s), 6) AS mean_time_per_query_s, round(avg(1 / time_per_query_s), 6) AS mean_qps,
  round(avg(recall_at_n), 6) AS mean_recall_at_n, count(*) AS n_queries FROM figures GROUP BY method""",
        "grid_figures": "WITH " + _figures() + """ SELECT method, round(avg(recall_at_n), 6) AS avg_recall, round(avg(time_per_query_s), 6) AS avg_time_per_query_s,
  round(count(*) / sum(time_per_query_s), 6) AS qps FROM figures GROUP BY method""",
        "tradeoff_series": "WITH " + _figures() + " SELECT method, round(count(*) / sum(time_per_query_s), 6) AS qps, round(avg(recall_at_n), 6) AS recall FROM figures GROUP BY method",
        "annotated_neighbors": "WITH " + _annotated() + f" SELECT {columns} FROM near_by",
        "remote_candidates": "WITH " + _annotated() + f" SELECT {columns} FROM near_by WHERE coalesce(blast_identity_pct, 0) < 60",
        "remote_outside_top": "WITH " + _annotated() + " SELECT method, query_id, rank, neighbor_id, l2_dist FROM near_by WHERE coalesce(blast_identity_pct, 0) < 60 AND NOT in_blast_top_n",
        "report_roundtrip": "WITH " + _annotated() + f""" SELECT CAST(query_id AS VARCHAR) AS query_id, method, rank, CAST(neighbor_id AS VARCHAR) AS neighbor_id,
  CAST(round(CAST(l2_dist AS DECIMAL(18, 4)), 2) AS DOUBLE) AS l2_dist, CAST(round_even(CAST(coalesce(blast_identity_pct, 0) AS DECIMAL(18, 6)), 0) AS DOUBLE) AS blast_identity_pct, in_blast_top_n
  FROM near_by WHERE rank <= {q.K}""",
        "report_summaries": "WITH " + _figures() + """ SELECT CAST(query_id AS VARCHAR) AS query_id, method, round(recall_at_n, 2) AS recall_at_n FROM figures
UNION ALL SELECT CAST(query_id AS VARCHAR), 'BLAST (Ref)', 1.0 FROM q""",
        "sequence_normalise": f"SELECT doc_id, upper(replace(replace(trim(text, {WHITE}), ' ', ''), 'ß', 'ss')) AS sequence FROM documents",
        "sequence_truncate": f"""SELECT doc_id, CAST(length(s) AS INTEGER) AS n, md5(s) AS digest FROM (
  SELECT doc_id, substr(upper(replace(replace(trim(text, {WHITE}), ' ', ''), 'ß', 'ss')), 1, {MAX_RESIDUES}) AS s FROM documents)""",
        "float_extract": f"SELECT doc_id, coalesce(try_cast(nullif(regexp_extract(text, '{NUMBER}', 0), '') AS DOUBLE), 0) AS x FROM documents",
        "fasta_roundtrip": f"SELECT doc_id, upper({letters}) AS sequence FROM documents",
        "fasta_lines": f"SELECT doc_id, CAST(1 + ceil(length({letters}) / 60.0) AS INTEGER) AS lines, true AS headed FROM documents",
        "subset_head": "SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 25",
        "train_sample": "SELECT vec_id FROM embeddings ORDER BY md5('1:' || CAST(vec_id AS VARCHAR)), vec_id LIMIT 100",
        "grid_configurations": "SELECT k, L, w FROM (VALUES (2), (4), (6)) a(k), (VALUES (5), (10)) b(L), (VALUES (CAST(2 AS DOUBLE)), (4.5)) c(w)",
        "kmer_seeds": f"""WITH s AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS s FROM documents),
k AS (SELECT doc_id, unnest({kmers}) AS kmer FROM s WHERE len(s) >= 6)
SELECT a.doc_id AS qseqid, b.doc_id AS sseqid, count(*) AS shared FROM k a JOIN k b ON a.kmer = b.kmer WHERE a.doc_id % {q.STEP} = 0 GROUP BY ALL HAVING count(*) >= 25""",
        "embed_sequences": f"""SELECT doc_id, 64 AS n, CASE WHEN length(s) >= 3 THEN 1.0 ELSE 0.0 END AS norm FROM (
  SELECT doc_id, substr(upper(replace(replace(trim(text, {WHITE}), ' ', ''), 'ß', 'ss')), 1, {MAX_RESIDUES}) AS s FROM documents)""",
        "masked_mean": _with(BASE) + """SELECT label, CAST(p - 1 AS INTEGER) AS p, round(sum(e * m) / greatest(sum(m), 1), 8) AS x FROM (
  SELECT label, CASE WHEN vec_id % 2 = 0 THEN 1.0 ELSE 0.0 END AS m, unnest(v) AS e, generate_subscripts(v, 1) AS p FROM x) GROUP BY label, p""",
        "search_pipeline": None,
        "grid_search": _sweep(),
        "ivf_pq_trained_checked": f"SELECT vec_id AS query_id, true AS whole, true AS once, true AS ranked, true AS exact FROM embeddings WHERE vec_id % {q.STEP} = 0",
        "neural_search_checked": f"SELECT vec_id AS query_id, true AS whole, true AS once, true AS ranked, true AS exact FROM embeddings WHERE vec_id % {q.STEP} = 0",
        "kmeans_fit_checked": f"SELECT count(*) AS n, {q.LLOYD_K} AS clusters, true AS closer, true AS at_rest FROM embeddings",
        "grid_all": "SELECT * FROM (VALUES ('lsh', 2, true), ('hypercube', 1, true), ('ivfflat', 2, true), ('ivfpq', 1, true), ('neural', 1, true)) t(method, configurations, possible)",
        "search_all": f"""SELECT method, (SELECT count(*) FROM embeddings WHERE vec_id % {q.STEP} = 0) AS n_queries, whole, true AS possible
FROM (VALUES ('Euclidean LSH', true), ('Hypercube', true), ('Neural LSH', true), ('IVF-Flat', true), ('IVF-PQ', true), ('BLAST (Ref)', CAST(NULL AS BOOLEAN))) t(method, whole)""",
    }
    full = _with(BASE, _lsh(q.LSH), _ranked(JOINED, q.N, "_a"), _ranked(EVERYTHING, q.N, "_e"), HITS, TRUTH, f"enough AS (SELECT query_id FROM r_a GROUP BY query_id HAVING count(*) >= {q.N})",
                 "answers AS (SELECT * FROM r_a WHERE query_id IN (SELECT query_id FROM enough) UNION ALL SELECT * FROM r_e WHERE query_id NOT IN (SELECT query_id FROM enough))")
    out["search_pipeline"] = full + f"""SELECT 'Euclidean LSH' AS method, a.query_id, a.rank, a.neighbor_id, a.l2_dist, h.pident AS blast_identity_pct, t.neighbor_id IS NOT NULL AS in_blast_top_n
FROM answers a LEFT JOIN hits h ON h.qseqid = a.query_id AND h.sseqid = a.neighbor_id
LEFT JOIN truth t ON t.query_id = a.query_id AND t.neighbor_id = a.neighbor_id WHERE a.rank <= {q.K}"""
    return {k: v for k, v in out.items() if v}
