"""Registered queries over the supplied tables, and the SQL that checks them.

Reads are derived from whole values: a document's, a page address's or a part name's
letters and digits as nucleotides (`functions.sequences.as_sequence`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions import alignment as A
from seqloom.functions import sequences as S
from seqloom.operators import consensus, graph, neighbors, records, significance
from seqloom.operators.lineage import written
from seqloom.sources import fasta


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`acc` (document id), `seq` of all documents that have letters or digits."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("acc"), S.as_sequence("text").alias("seq")).where("seq <> ''")


def short_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`acc`, `seq` of all page addresses and part names."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("acc"), S.as_sequence("url").alias("seq"))
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("acc"), S.as_sequence("p_name").alias("seq"))
    return pages.union(parts).where("seq <> ''")


_ALPHABET = "translate(regexp_replace(lower({0}), '[^a-z0-9]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz0123456789', 'ACGTACGTACGTACGTACGTACGTACGTACGTACGT')"
_DOCUMENTS = f"d AS (SELECT doc_id AS acc, {_ALPHABET.format('text')} AS seq FROM documents), reads AS (SELECT * FROM d WHERE seq <> '')"
_SHORT = f"""d AS (SELECT 'page/' || page_id AS acc, {_ALPHABET.format('url')} AS seq FROM pages
  UNION ALL SELECT 'part/' || p_partkey, {_ALPHABET.format('p_name')} FROM part), reads AS (SELECT * FROM d WHERE seq <> ''),
nodes AS (SELECT seq, count(*) AS degree, max(acc) AS acc FROM reads GROUP BY seq)"""
_GRAPH = f"""{_SHORT},
pairs AS (SELECT q.seq AS q, t.seq AS t, levenshtein(q.seq, t.seq) AS ed FROM nodes q JOIN nodes t ON q.seq <> t.seq WHERE q.degree = 1),
near AS (SELECT q, t, ed FROM (SELECT *, min(ed) OVER (PARTITION BY q) AS best FROM pairs WHERE ed <= length(q)) WHERE ed = best)"""

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query and the SQL with the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Reads and scalars


@query(f"WITH {_DOCUMENTS} SELECT md5(seq) AS seq_md5, count(*) AS degree, min(acc) AS first_acc, max(acc) AS last_acc, count(*) > 1 AS converged FROM reads GROUP BY seq")
def dedup_multiplicity(spark, sf_dir):
    groups = document_reads(spark, sf_dir).groupBy("seq").agg(F.count("*").alias("degree"), F.min("acc").alias("first_acc"), F.max("acc").alias("last_acc"))
    return groups.select(F.md5("seq").alias("seq_md5"), "degree", "first_acc", "last_acc", (F.col("degree") > 1).alias("converged"))


@query(f"WITH {_DOCUMENTS} SELECT CAST(length(seq) AS BIGINT) AS len, count(*) AS n, (SELECT CAST(min(length(seq)) AS BIGINT) FROM reads) AS shortest, (SELECT CAST(max(length(seq)) AS BIGINT) FROM reads) AS longest FROM reads GROUP BY length(seq)")
def length_histogram(spark, sf_dir):
    counts = document_reads(spark, sf_dir).groupBy(F.length("seq").cast("bigint").alias("len")).agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("len").alias("shortest"), F.max("len").alias("longest"))  # one row
    return counts.join(F.broadcast(ends), F.lit(True))


_COMPRESSED = "string_agg(CASE WHEN c IS DISTINCT FROM p THEN c ELSE '' END, '' ORDER BY i)"
_COMPRESS = f"""{_DOCUMENTS}, chars AS (SELECT acc, i, seq[i] AS c, CASE WHEN i > 1 THEN seq[i - 1] END AS p FROM reads, unnest(range(1, length(seq) + 1)) AS u(i)),
compressed AS (SELECT acc, {_COMPRESSED} AS c FROM chars GROUP BY acc)"""


@query(f"WITH {_COMPRESS} SELECT acc, CAST(length(c) AS BIGINT) AS len, md5(c) AS compressed_md5 FROM compressed")
def homopolymer_compress(spark, sf_dir):
    c = S.homopolymer_compressed("seq")
    return document_reads(spark, sf_dir).select("acc", F.length(c).cast("bigint").alias("len"), F.md5(c).alias("compressed_md5"))


@query(f"""WITH {_DOCUMENTS}, chars AS (SELECT acc, i, seq[i] AS c, CASE WHEN i > 1 THEN seq[i - 1] END AS p FROM reads, unnest(range(1, length(seq) + 1)) AS u(i)),
ids AS (SELECT acc, i, sum(CAST(c IS DISTINCT FROM p AS INTEGER)) OVER (PARTITION BY acc ORDER BY i) - 1 AS id FROM chars)
SELECT acc, CAST(max(id) + 1 AS BIGINT) AS n_runs, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY i)) AS ids_md5 FROM ids GROUP BY acc""")
def homopolymer_runs(spark, sf_dir):
    ids = S.run_ids("seq")
    return document_reads(spark, sf_dir).select("acc", F.size(S.runs("seq")).cast("bigint").alias("n_runs"), F.md5(F.array_join(ids, ",")).alias("ids_md5"))


@query(f"""WITH {_SHORT}, chars AS (SELECT acc, i, seq[i] AS c, CASE WHEN i > 1 THEN seq[i - 1] END AS p FROM nodes, unnest(range(1, length(seq) + 1)) AS u(i)),
compressed AS (SELECT acc, {_COMPRESSED} AS c FROM chars GROUP BY acc)
SELECT x.acc AS a, y.acc AS b FROM compressed x JOIN compressed y ON x.c = y.c AND x.acc <> y.acc""")
def homopolymer_groups(spark, sf_dir):
    return neighbors.homopolymer_pairs(neighbors.distinct_sequences(short_reads(spark, sf_dir)))


@query(f"WITH {_DOCUMENTS} SELECT acc, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS rc_md5 FROM reads")
def reverse_complement(spark, sf_dir):
    return document_reads(spark, sf_dir).select("acc", F.md5(S.reverse_complement("seq")).alias("rc_md5"))


@query("SELECT l_orderkey, l_linenumber, round(pow(10, -l_quantity / 10), 12) AS p_error, round(-10 * log10(pow(10, -l_quantity / 10)), 9) AS phred FROM lineitem")
def phred_to_prob(spark, sf_dir):
    p = S.error_probability("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(p, 12).alias("p_error"), F.round(S.phred_of(p), 9).alias("phred"))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - 3) * (43 - 3) / 90 + 3, 9) AS trusted FROM lineitem")
def phred_remap(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.trusted_phred("l_quantity"), 9).alias("trusted"))


@query("SELECT c_custkey, list_transform(string_split(c_name, ''), lambda c: CAST(ascii(c) - 33 AS INTEGER)) AS phred FROM customer")
def phred_parse(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.phred_values("c_name").alias("phred"))


@query("SELECT s_suppkey, 'transcript_' || s_suppkey || '_support_' || (s_suppkey % 7) AS acc, CAST(s_suppkey % 7 AS INTEGER) AS support FROM supplier WHERE s_suppkey % 7 >= 2")
def candidate_support(spark, sf_dir):
    named = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("transcript_"), "s_suppkey", F.lit("_support_"), F.col("s_suppkey") % 7).alias("acc"))
    return named.withColumn("support", S.support_of("acc")).where("support is null or support >= 2")


@query(f"""WITH {_SHORT}, a AS (SELECT acc, 'chr/' || replace(acc, '/', '_') || '/ccs extra' AS long FROM reads)
SELECT acc, split_part(split_part(long, ' ', 1), '/', 1) || '/' || split_part(split_part(long, ' ', 1), '/', 2) AS read_id FROM a""")
def read_quality_key(spark, sf_dir):
    long = F.concat(F.lit("chr/"), F.replace(F.col("acc"), F.lit("/"), F.lit("_")), F.lit("/ccs extra"))
    return short_reads(spark, sf_dir).select("acc", S.read_key(long).alias("read_id"))


@query(f"""WITH {_SHORT}, al AS (SELECT acc, repeat('-', CAST(degree AS INTEGER) % 24) || seq || repeat('-', length(seq) % 5) AS a, seq || repeat('A', CAST(degree AS INTEGER) % 24 + length(seq) % 5) AS b FROM nodes),
m AS (SELECT *, length(a) - length(ltrim(a, '-')) AS s, length(rtrim(a, '-')) AS e FROM al)
SELECT acc, CAST(s AS INTEGER) AS mask_start, CAST(e AS INTEGER) AS mask_end,
  contains(substr(a, CAST(least(15, s) AS INTEGER) + 1, CAST(greatest(greatest(length(a) - 15, e) - least(15, s), 0) AS INTEGER)), repeat('-', 5)) AS dropped FROM m""")
def exon_filter(spark, sf_dir):
    nodes = neighbors.distinct_sequences(short_reads(spark, sf_dir))
    lead, tail = (F.col("degree") % 24).cast("int"), F.length("seq") % 5
    pair = nodes.select("acc", F.concat(F.repeat(F.lit("-"), lead), "seq", F.repeat(F.lit("-"), tail)).alias("a"), F.concat("seq", F.repeat(F.lit("A"), lead + tail)).alias("b"))
    return pair.select("acc", S.mask_start("a", "b").alias("mask_start"), S.mask_end("a", "b").alias("mask_end"), S.differs_by_exon("a", "b", 5, 15).alias("dropped"))


# Neighbours and graphs


@query(f"WITH {_GRAPH} SELECT q, t, ed FROM near")
def nn_graph(spark, sf_dir):
    return neighbors.neighbour_graph(short_reads(spark, sf_dir)).select("q", "t", F.col("ed").cast("bigint").alias("ed"))


@query(f"""WITH {_SHORT}, ranked AS (SELECT *, row_number() OVER (ORDER BY length(seq), seq) AS r FROM nodes),
pairs AS (SELECT q.seq AS q, t.seq AS t, levenshtein(q.seq, t.seq) AS ed FROM ranked q JOIN ranked t ON q.seq <> t.seq AND abs(q.r - t.r) <= 10 WHERE q.degree = 1)
SELECT q, t, ed FROM (SELECT *, min(ed) OVER (PARTITION BY q) AS best FROM pairs WHERE ed <= length(q)) WHERE ed = best""")
def nn_graph_depth(spark, sf_dir):
    return neighbors.neighbour_graph(short_reads(spark, sf_dir), depth=10).select("q", "t", F.col("ed").cast("bigint").alias("ed"))


@query(f"""WITH {_SHORT}, c AS (SELECT DISTINCT {_ALPHABET.format("p_type || ' ' || p_name")} AS seq FROM part),
pairs AS (SELECT q.seq AS q, c.seq AS t, levenshtein(q.seq, c.seq) AS ed FROM nodes q CROSS JOIN c)
SELECT q, t, ed FROM (SELECT *, min(ed) OVER (PARTITION BY q) AS best FROM pairs WHERE ed <= length(q)) WHERE ed = best""")
def two_set_nn(spark, sf_dir):
    candidates = table(spark, sf_dir, "part").select(S.as_sequence(F.concat_ws(" ", "p_type", "p_name")).alias("seq")).distinct()
    reads = short_reads(spark, sf_dir).select("seq").distinct()
    return neighbors.nearest(reads, candidates, self_join=False).select("q", "t", F.col("ed").cast("bigint").alias("ed"))


@query(f"""WITH b AS (SELECT DISTINCT {_ALPHABET.format('text')} AS seq FROM benchmark), n AS (SELECT * FROM b WHERE seq <> ''),
pairs AS (SELECT q.seq AS q, t.seq AS t, levenshtein(q.seq, t.seq) AS ed FROM n q JOIN n t ON q.seq <> t.seq)
SELECT md5(q) AS q_md5, md5(t) AS t_md5, ed FROM (SELECT *, min(ed) OVER (PARTITION BY q) AS best FROM pairs WHERE ed <= length(q)) WHERE ed = best""")
def benchmark_neighbours(spark, sf_dir):
    """Whole texts that mostly resemble nothing: bounds and blocks."""
    texts = table(spark, sf_dir, "benchmark").select(S.as_sequence("text").alias("seq")).where("seq <> ''").distinct()
    found = neighbors.nearest(texts, texts, self_join=True)
    return found.select(F.md5("q").alias("q_md5"), F.md5("t").alias("t_md5"), F.col("ed").cast("bigint").alias("ed"))


@query(f"""WITH {_SHORT}, p AS (SELECT x.acc AS a, y.acc AS b, x.seq AS s, y.seq AS u, strpos(x.seq, y.seq) - 1 AS pos FROM nodes x JOIN nodes y ON x.seq <> y.seq AND length(y.seq) <= length(x.seq) AND length(y.seq) >= length(x.seq) - 6)
SELECT a, b FROM p WHERE (pos BETWEEN 0 AND 3 AND length(s) - pos - length(u) <= 3)
 OR len(list_filter(range(greatest(length(s) - 3, 1), length(s) + 1), lambda n: n <= length(u) AND (right(s, CAST(n AS INTEGER)) = left(u, CAST(n AS INTEGER)) OR right(u, CAST(n AS INTEGER)) = left(s, CAST(n AS INTEGER))))) > 0""")
def ends_containment(spark, sf_dir):
    return neighbors.equivalent_pairs(neighbors.distinct_sequences(short_reads(spark, sf_dir)), 3)


@query(f"WITH {_GRAPH}, both_ways AS (SELECT q, t, ed FROM near UNION ALL SELECT t, q, ed FROM near) SELECT q, t, min(ed) AS ed FROM both_ways GROUP BY q, t")
def symmetric_graph(spark, sf_dir):
    return graph.symmetrised(nn_graph(spark, sf_dir))


@query(f"WITH {_GRAPH}, isolated AS (SELECT seq FROM nodes EXCEPT (SELECT q FROM near UNION SELECT t FROM near)) SELECT seq, degree FROM nodes SEMI JOIN isolated USING (seq)")
def isolated_nodes(spark, sf_dir):
    edges = nn_graph(spark, sf_dir)
    touched = edges.select(F.explode(F.array("q", "t")).alias("seq")).distinct()
    return neighbors.distinct_sequences(short_reads(spark, sf_dir)).select("seq", "degree").join(touched, "seq", "left_anti")


@query(f"""WITH RECURSIVE {_GRAPH}, links AS (SELECT q, t FROM near WHERE ed <= 3 UNION SELECT t, q FROM near WHERE ed <= 3),
walk AS (SELECT seq AS node, seq AS top FROM nodes UNION SELECT l.t, w.top FROM walk w JOIN links l ON l.q = w.node)
SELECT node, min(top) AS component FROM walk GROUP BY node""")
def components(spark, sf_dir):
    nodes = neighbors.distinct_sequences(short_reads(spark, sf_dir)).select(F.col("seq").alias("node"))
    return graph.components(nodes, nn_graph(spark, sf_dir).where("ed <= 3"))


@query()
def greedy_partition(spark, sf_dir):
    nodes = neighbors.distinct_sequences(short_reads(spark, sf_dir)).select(F.col("seq").alias("node"), "degree")
    return graph.partition(nodes, written(nn_graph(spark, sf_dir), "graph"))


@query()
def greedy_assignment(spark, sf_dir):
    edges = written(two_set_nn(spark, sf_dir).select(F.col("q").alias("read"), F.col("t").alias("candidate")), "edges")
    return graph.greedy_assignment(edges)


@query(f"""WITH {_SHORT}, c AS (SELECT DISTINCT {_ALPHABET.format("p_type || ' ' || p_name")} AS seq FROM part),
pairs AS (SELECT q.seq AS q, c.seq AS t, levenshtein(q.seq, c.seq) AS ed FROM nodes q CROSS JOIN c),
near AS (SELECT q, t FROM (SELECT *, min(ed) OVER (PARTITION BY q) AS best FROM pairs WHERE ed <= length(q)) WHERE ed = best)
SELECT t AS candidate, count(*) AS n FROM near GROUP BY t ORDER BY n DESC, t LIMIT 1""")
def assignment_first_pick(spark, sf_dir):
    counts = two_set_nn(spark, sf_dir).groupBy(F.col("t").alias("candidate")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "candidate").limit(1)  # the greedy choice itself


@query(f"WITH {_SHORT}, c AS (SELECT seq, degree, row_number() OVER (ORDER BY seq) - 1 AS i FROM nodes WHERE degree >= 2) SELECT 'transcript_' || i || '_support_' || degree AS acc, seq FROM c")
def candidate_names(spark, sf_dir):
    kept = neighbors.distinct_sequences(short_reads(spark, sf_dir)).where("degree >= 2")
    return records.named(kept).select("acc", "seq")


# Profiles and correction


# Sequences whose lengths fall into one bucket of eight, filled up with gaps: columns that most lack are insertions of the rest.
_LONG = f"""{_SHORT}, padded AS (SELECT CAST(length(seq) // 8 AS VARCHAR) AS center, seq AS member, degree, rpad(seq, CAST(length(seq) // 8 * 8 + 7 AS INTEGER), '-') AS a FROM nodes),
long AS (SELECT center, member, degree, CAST(i - 1 AS INTEGER) AS col, a[i] AS char FROM padded, unnest(range(1, length(a) + 1)) AS u(i)),
profile AS (SELECT center, col, char, CAST(sum(degree) AS BIGINT) AS n FROM long GROUP BY center, col, char),
tops AS (SELECT center, col, min(char) AS top, count(*) > 1 AS ambiguous FROM (SELECT *, max(n) OVER (PARTITION BY center, col) AS m FROM profile) WHERE n = m GROUP BY center, col),
errors AS (SELECT center, CAST(coalesce(sum(n) FILTER (top = '-'), 0) AS BIGINT) AS c_ins, CAST(coalesce(sum(n) FILTER (top <> '-' AND char = '-'), 0) AS BIGINT) AS c_del,
  CAST(coalesce(sum(n) FILTER (top <> '-' AND char <> '-'), 0) AS BIGINT) AS c_subs FROM profile JOIN tops USING (center, col) WHERE NOT ambiguous AND char <> top GROUP BY center)"""


def _by_length(spark, sf_dir) -> DataFrame:
    nodes = neighbors.distinct_sequences(short_reads(spark, sf_dir))
    bucket = F.floor(F.length("seq") / 8)
    padded = F.rpad("seq", (bucket * 8 + 7).cast("int"), F.lit("-"))
    return consensus.positions(nodes.select(bucket.cast("string").alias("center"), F.col("seq").alias("member"), "degree", F.filter(F.split(padded, ""), lambda c: c != "").alias("columns")))


@query(f"WITH {_LONG} SELECT * FROM profile")
def pfm(spark, sf_dir):
    return consensus.profile(_by_length(spark, sf_dir))


@query(f"WITH {_LONG} SELECT * FROM tops")
def majority(spark, sf_dir):
    return consensus.majorities(pfm(spark, sf_dir))


@query(f"WITH {_LONG} SELECT * FROM errors")
def error_types(spark, sf_dir):
    p = pfm(spark, sf_dir)
    return consensus.error_counts(p, consensus.majorities(p))


@query(f"""WITH {_LONG}, minor AS (SELECT center, member, col, top, n / greatest(CASE WHEN top = '-' THEN c_ins WHEN char = '-' THEN c_del ELSE c_subs END, 1) AS f FROM long JOIN tops USING (center, col) JOIN profile USING (center, col, char) JOIN errors USING (center)
  WHERE degree <= 1 AND NOT ambiguous AND char <> top)
SELECT center, member, col, top, round(f, 9) AS frequency FROM (SELECT *, rank() OVER (PARTITION BY center, member ORDER BY f) AS r, count(*) OVER (PARTITION BY center, member) AS n FROM minor) WHERE r <= ceil(n * 0.5)""")
def minority_rank_cut(spark, sf_dir):
    long = _by_length(spark, sf_dir)
    p = consensus.profile(long)
    tops = consensus.majorities(p)
    return consensus.to_replace(long, p, tops, consensus.error_counts(p, tops)).withColumn("frequency", F.round("frequency", 9))


@query()
def partition_alignment(spark, sf_dir):
    return consensus.aligned(greedy_partition(spark, sf_dir).select("center", "member", "degree"))


@query()
def consensus_correction(spark, sf_dir):
    return consensus.corrected(written(partition_alignment(spark, sf_dir), "partition"))


@query()
def ends_adjusted_graph(spark, sf_dir):
    nodes = neighbors.distinct_sequences(short_reads(spark, sf_dir))
    return neighbors.close_but_ends(nodes.select("acc", "seq"), ends=3)


# Tests


@query("""WITH t AS (SELECT l_orderkey, ln(pow(10, -((l_quantity - 3) * (43 - 3) / 90 + 3) / 10)) AS lp, l_returnflag = 'R' AS s FROM lineitem),
g AS (SELECT l_orderkey, min(lp) AS least, count(*) AS n_t, CAST(sum(CAST(s AS INTEGER)) AS BIGINT) AS k, sum(lp * exp(lp)) AS wp, sum(CASE WHEN s THEN lp ELSE 0 END) AS wy FROM t GROUP BY l_orderkey),
b AS (SELECT l_orderkey, k, n_t, wp / least AS m, wy / least AS y FROM g)
SELECT l_orderkey, k, n_t, round(CASE WHEN y = 0 THEN 0 WHEN y = m THEN ln(0.5) ELSE y - m - y * ln(y / m) END, 6) + 0.0 AS ln_p FROM b""")
def tail_bound(spark, sf_dir):
    p = S.error_probability(S.trusted_phred("l_quantity"))
    trials = table(spark, sf_dir, "lineitem").select("l_orderkey", p.alias("p"), (F.col("l_returnflag") == "R").alias("supports"))
    return significance.tail_bounds(trials, ["l_orderkey"]).select("l_orderkey", "k", "n_t", (F.round("ln_p", 6) + 0.0).alias("ln_p"))


_CHOOSE = "list_sum(list_transform(range(1, CAST({1} AS BIGINT) + 1), lambda i: ln(({0} - {1} + i) / i)))"


@query(f"""WITH v AS (SELECT p_partkey, 100 + p_size AS len, p_partkey % 3 AS ins, p_partkey % 4 AS dels, p_partkey % 5 AS subs FROM part)
SELECT p_partkey, round(ins * ln(4.0 * (len + 1)) + coalesce({_CHOOSE.format('len', 'dels')}, 0) + coalesce({_CHOOSE.format('(3 * (len - dels))', 'subs')}, 0), 6) AS ln_factor FROM v""")
def correction_factor(spark, sf_dir):
    k = F.col("p_partkey")
    factor = significance.ln_factor((100 + F.col("p_size")).cast("bigint"), k % 3, k % 4, k % 5)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(factor, 6).alias("ln_factor"))


@query("SELECT round(greatest(median(c_acctbal / 10000), 0.01), 9) AS threshold FROM customer")
def median_threshold(spark, sf_dir):
    tests = table(spark, sf_dir, "customer").select((F.col("c_acctbal") / 10000).alias("corrected"))
    return significance.threshold(tests).select(F.round("threshold", 9).alias("threshold"))


@query("""WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), e AS (SELECT DISTINCT user_id AS candidate, (user_id * 7 + 1) % 50 AS reference FROM events)
SELECT candidate, reference, c.n AS n_c, t.n AS n_t FROM e JOIN n c ON c.user_id = candidate JOIN n t ON t.user_id = reference WHERE c.n < 2 * t.n""")
def dominance_filter(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    counts = events.groupBy(F.col("user_id").alias("acc")).agg(F.count("*").alias("n"))
    edges = events.select(F.col("user_id").alias("candidate"), ((F.col("user_id") * 7 + 1) % 50).alias("reference")).distinct()
    return significance.not_dominated(edges, counts, 2).select("candidate", "reference", "n_c", "n_t")


@query("""SELECT o_custkey AS candidate, o_orderkey AS reference, o_totalprice AS corrected FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) = 1""")
def worst_edge(spark, sf_dir):
    tests = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("candidate"), F.col("o_orderkey").alias("reference"), F.col("o_totalprice").alias("corrected"))
    return significance.worst_edges(tests)


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def unassigned(spark, sf_dir):
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("read"))
    return graph.unassigned(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("acc")), labelled).select(F.col("acc").alias("doc_id"))


@query("SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON o_custkey = c_custkey")
def survivors(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("acc")).agg(F.count("*").alias("n"))
    return graph.with_reads(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("acc"), "c_name"), counts).select(F.col("acc").alias("c_custkey"), "c_name")


@query("""WITH o AS (SELECT o_custkey AS q, o_orderkey % 100 AS t, min(o_totalprice) AS w FROM orders GROUP BY 1, 2), n AS (SELECT c_custkey AS q, CAST(c_nationkey AS BIGINT) AS t, c_acctbal AS w FROM customer)
SELECT q, t, w FROM o UNION ALL SELECT q, t, w FROM n ANTI JOIN o USING (q, t)""")
def edge_union(spark, sf_dir):
    old = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("q"), (F.col("o_orderkey") % 100).alias("t")).agg(F.min("o_totalprice").alias("w"))
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("q"), F.col("c_nationkey").cast("bigint").alias("t"), F.col("c_acctbal").alias("w"))
    return graph.united(old, new, ["q", "t"])


@query(f"WITH {_GRAPH}, alive AS (SELECT seq FROM nodes WHERE degree >= 2 UNION SELECT q FROM near WHERE ed <= 3), e AS (SELECT * FROM pairs SEMI JOIN alive ON alive.seq = pairs.q), f AS (SELECT * FROM near SEMI JOIN alive ON alive.seq = near.q), g AS (SELECT * FROM f SEMI JOIN alive ON alive.seq = f.t) SELECT q, t, ed FROM (SELECT *, min(ed) OVER (PARTITION BY q) AS b FROM g) WHERE ed = b")
def survivors_nearest(spark, sf_dir):
    # What the support rule keeps, and what is close to its neighbours.
    edges = written(nn_graph(spark, sf_dir), "graph")
    supported = neighbors.distinct_sequences(short_reads(spark, sf_dir)).where("degree >= 2").select(F.col("seq").alias("acc"))
    return neighbors.survivors_nearest(edges, supported.union(edges.where("ed <= 3").select("q")).distinct())


@query("SELECT l_shipdate_year AS grp, x[CAST(floor(len(x) * 0.9) AS INTEGER) + 1] AS quantile FROM (SELECT year(l_shipdate) AS l_shipdate_year, list_sort(list(l_extendedprice)) AS x FROM lineitem GROUP BY 1)")
def indexed_quantile(spark, sf_dir):
    # sorted[int(n * 0.9)], by the count below each distinct value instead of a list of all values.
    prices = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").cast("bigint").alias("grp"), F.col("l_extendedprice").alias("x")).count()
    upto = F.sum("count").over(W.partitionBy("grp").orderBy("x"))
    total = F.sum("count").over(W.partitionBy("grp"))
    return prices.withColumn("_u", upto).withColumn("_n", total).where(F.col("_u") > F.floor(F.col("_n") * 0.9)).groupBy("grp").agg(F.min("x").alias("quantile"))


# Outputs


@query(f"WITH {_DOCUMENTS} SELECT acc, md5('>doc_' || acc || chr(10) || seq) AS record_md5, CAST(length(seq) AS BIGINT) AS len FROM reads")
def fasta_record(spark, sf_dir):
    record = fasta.fasta_text(F.concat(F.lit("doc_"), F.col("acc").cast("string")), F.col("seq"))
    return document_reads(spark, sf_dir).select("acc", F.md5(record).alias("record_md5"), F.length("seq").cast("bigint").alias("len"))


@query("""WITH f AS (SELECT c_custkey AS acc, c_name AS seq, count(o_orderkey) AS n, min(o_totalprice / 1000000) AS p FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT acc || '_' || n || '_' || CASE WHEN p IS NULL THEN 'not_tested' ELSE 'tested' END || '_' || n || '_' || n % 3 AS acc, seq FROM f""")
def final_record(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left").select(F.col("c_custkey").cast("string").alias("acc"), F.col("c_name").alias("seq"), F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNotNull(), F.lit("tested")).alias("p_value"))
    return records.final_records(rows.withColumn("n_t", F.col("n")).withColumn("n_variants", F.col("n") % 3))


@query(f"WITH {_DOCUMENTS}, c AS (SELECT source, min(doc_id) AS candidate FROM documents JOIN reads ON acc = doc_id GROUP BY source) SELECT r.acc AS read, candidate, length(r.seq) AS read_len, length(k.seq) AS candidate_len FROM reads r JOIN documents ON doc_id = r.acc JOIN c USING (source) JOIN reads k ON k.acc = candidate")
def cluster_info(spark, sf_dir):
    reads = document_reads(spark, sf_dir)
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("acc"), "source")
    first = reads.join(sources, "acc").groupBy("source").agg(F.min("acc").alias("candidate"))
    assignment = reads.join(sources, "acc").join(first, "source").select(F.col("acc").alias("read"), "candidate")
    final = reads.join(first, F.col("acc") == F.col("candidate"), "left_semi")
    out = records.cluster_table(assignment, reads, final)
    return out.select("read", "candidate", F.col("read_len").cast("bigint").alias("read_len"), F.col("candidate_len").cast("bigint").alias("candidate_len"))
