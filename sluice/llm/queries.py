"""Every operator of this folder as a query over the given tables, with its SQL counterpart
where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sluice.plans.registry import table
from sluice.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(use_utc(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return add


SHINGLES = """shingled AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[ \\t-\\r]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []::VARCHAR[]
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM shingled)"""

NEAR_SQL = f"""WITH RECURSIVE {SHINGLES},
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
   AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(node, seen) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT l.v, r.seen FROM reach r JOIN links l ON l.u = r.node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.seen) AS component_id, s.doc_id = min(r.seen) AS kept
FROM sets s JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, len(s.s)"""


@query("op9_minhash_near_dedup", NEAR_SQL)
def op9(spark, sf_dir):
    """Three-word shingles, similarity of 85 in a hundred."""
    from sluice.llm.minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


@query("op5_sharding")
def op5(spark, sf_dir):
    """40 contiguous shards of equal bytes."""
    from sluice.llm.sharding import byte_shards

    return byte_shards(table(spark, sf_dir, "documents"), 40)


TOPK_SQL = """WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e::DOUBLE[], d.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id),
ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
  FROM scored)
SELECT * FROM ranked WHERE rank <= 10"""


@query("op6_exact_top_k", TOPK_SQL)
def op6(spark, sf_dir):
    """The ten nearest of every hundredth vector."""
    from pyspark.sql import functions as F

    from sluice.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@query("op10_best_fit_packing")
def op10(spark, sf_dir):
    """Words packed into sequences of 1,024 to 8,192."""
    from sluice.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


@query("op8_language_mixture")
def op8(spark, sf_dir):
    """Language of every document; learned from three quarters of the labelled ones."""
    from sluice.llm.language import fit, held_out, identify

    docs = table(spark, sf_dir, "documents")
    apart = held_out(4, 2)
    found = identify(docs, fit(docs, ~apart))
    return found.select("doc_id", apart.alias("held_out"), "lang_pred", "score", "languages")


@query("op2_line_dedup")
def op2(spark, sf_dir):
    """Every document freed of the blocks it shares with an earlier one."""
    from sluice.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "lines_removed", "text")


@query("op7_benchmark_decontamination")
def op7(spark, sf_dir):
    """Every document against every benchmark item."""
    from sluice.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_quality_convolution")
def op1(spark, sf_dir):
    """Quality of every document; two thirds of the labels may be learned from."""
    from sluice.llm.language import held_out
    from sluice.llm.quality import fit, quality

    docs, apart = table(spark, sf_dir, "documents"), held_out(3, 1)
    scored = quality(docs, fit(docs, table(spark, sf_dir, "labels"), ~apart))
    return scored.select("doc_id", apart.alias("held_out"), "score", "predicted")


@query("op3_toxicity_lexicon")
def op3(spark, sf_dir):
    """Toxicity of every document; four fifths of the labels may be learned from."""
    from sluice.llm.language import held_out
    from sluice.llm.toxicity import fit, toxicity

    docs, apart = table(spark, sf_dir, "documents"), held_out(5, 0)
    scored = toxicity(docs, fit(docs, table(spark, sf_dir, "labels"), ~apart))
    return scored.select("doc_id", apart.alias("held_out"), "score", "predicted", "level", "hits")


@query("op4_pii_semi_markov")
def op4(spark, sf_dir):
    """Personal data in every document."""
    from sluice.llm.pii import fit, personal_data

    docs = table(spark, sf_dir, "documents")
    return personal_data(docs, fit(docs))


def _node(runs: str) -> str:
    return f"list_transform(range(0, (len({runs}) + 7) // 8), lambda i: sha256(array_to_string({runs}[8 * i + 1 : 8 * i + 8], '')))"


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR))::VARCHAR || ':' || {value}::VARCHAR, '-')"


_CRC_STEP = "xor(c >> 1, 3988292384 * (c & 1))"
_CRC = ("xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), "
        "lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda c, _i: " + _CRC_STEP + ")))")

MERKLE_SQL = f"""WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} AS head, text,
    {_CRC} % 3 = 0 AS changed FROM documents),
hashed AS (
  SELECT doc_id, lang, sha256(head || {_field('text')}) AS leaf,
    CASE WHEN changed THEN sha256(head || {_field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS found
  FROM leaves),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS idx FROM hashed),
low(lang, level, nodes) AS (
  SELECT lang, 0, list(leaf ORDER BY idx) FROM placed GROUP BY lang
  UNION ALL SELECT lang, level + 1, {_node('nodes')} FROM low WHERE len(nodes) > 1),
sub AS (SELECT lang, level AS height, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM low WHERE len(nodes) = 1),
high(level, nodes) AS (
  SELECT 0, list(subroot ORDER BY place) FROM sub
  UNION ALL SELECT level + 1, {_node('nodes')} FROM high WHERE len(nodes) > 1),
steps AS (
  SELECT p.doc_id, p.lang, p.leaf, p.found, s.subroot, l.level, l.nodes, (p.idx // (8 ** l.level)::BIGINT)::BIGINT AS spot
  FROM placed p JOIN sub s ON p.lang IS NOT DISTINCT FROM s.lang JOIN low l ON p.lang IS NOT DISTINCT FROM l.lang WHERE len(l.nodes) > 1
  UNION ALL
  SELECT p.doc_id, p.lang, p.leaf, p.found, s.subroot, s.height + h.level, h.nodes, (s.place // (8 ** h.level)::BIGINT)::BIGINT
  FROM placed p JOIN sub s ON p.lang IS NOT DISTINCT FROM s.lang CROSS JOIN high h WHERE len(h.nodes) > 1),
sides AS (
  SELECT doc_id, lang, leaf, found, subroot, level,
    array_to_string(nodes[(spot // 8) * 8 + 1 : spot], '') AS before, array_to_string(nodes[spot + 2 : (spot // 8) * 8 + 8], '') AS after
  FROM steps),
ways AS (
  SELECT p.doc_id, p.lang, p.leaf, any_value(s.subroot) AS subroot, coalesce(p.found, p.leaf) AS start,
    coalesce(string_agg(d.before || d.after, '' ORDER BY d.level), '') AS proof,
    coalesce(list([d.before, d.after] ORDER BY d.level) FILTER (d.level IS NOT NULL), []) AS way
  FROM placed p JOIN sub s ON p.lang IS NOT DISTINCT FROM s.lang
  LEFT JOIN sides d ON d.doc_id IS NOT DISTINCT FROM p.doc_id AND d.leaf = p.leaf GROUP BY p.doc_id, p.lang, p.leaf, p.found),
folded AS (
  SELECT *, list_reduce(list_prepend([start], way), lambda a, s: [sha256(s[1] || a[1] || s[2])])[1] AS folded_root FROM ways)
SELECT doc_id, lang, leaf, subroot, (SELECT nodes[1] FROM high WHERE len(nodes) = 1) AS root, sha256(proof) AS proof_sha256, folded_root,
  folded_root = (SELECT nodes[1] FROM high WHERE len(nodes) = 1) AS verified FROM folded"""


@query("op13_merkle_manifest", MERKLE_SQL)
def op13(spark, sf_dir):
    """The manifest's proof of every document, checked against a copy with changed rows."""
    from sluice.llm.merkle import manifest_proofs

    return manifest_proofs(table(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    """Where a public vocabulary lies: below ``spark.sluice.tokenizers`` if the session names it, else in the installed package."""
    named = SparkSession.getActiveSession().conf.get("spark.sluice.tokenizers", None)
    if named:
        return f"{named.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op11_token_alignment")
def op11(spark, sf_dir):
    """Byte-level against piece tokens of every document."""
    from sluice.llm.token_alignment import align_tokens

    return align_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


@query("op12_chunk_bpe")
def op12(spark, sf_dir):
    """Every document encoded and decoded again."""
    from sluice.llm.chunk_bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
