"""The operators' queries, and SQL for those that SQL can express.

The others learn, hash, tokenize or sample in ways that SQL has no words for; tests compare them with brute force, exact round trips or
held-out accuracy instead.
"""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from wayfold.llm.filters import op12_filter_audit
from wayfold.llm.jaccard import op4_jaccard
from wayfold.llm.language import op3_language
from wayfold.llm.licenses import op8_licenses
from wayfold.llm.mtree import op5_mtree
from wayfold.llm.packing import op2_packing
from wayfold.llm.pieces import op9_sentencepiece
from wayfold.llm.routing import op11_learned_partitions
from wayfold.llm.sharding import op7_sharding
from wayfold.llm.telephony import op10_telephony
from wayfold.llm.toxicity import op6_toxicity
from wayfold.llm.treap import op13_treap_search
from wayfold.llm.warc import op1_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_warc, op2_packing, op3_language, op4_jaccard, op5_mtree, op6_toxicity, op7_sharding, op8_licenses, op9_sentencepiece, op10_telephony, op11_learned_partitions, op12_filter_audit, op13_treap_search]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


# Payloads are equal where the texts are; base 32 takes five hexadecimal digits of the digest as four of its own.
_WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS best FROM p)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST((CAST('0x' || substr(hex, CAST(i // 4 AS INTEGER) * 5 + 1, 5) AS INTEGER) >> (15 - 5 * CAST(i % 4 AS INTEGER))) & 31 AS INTEGER) + 1, 1) FOR i IN range(0, 32)], '') AS payload_digest,
        CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM d"""
_JACCARD = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')] ELSE list_distinct([array_to_string(words[i:i + 3], ' ') FOR i IN range(1, len(words) - 2)]) END AS shingles FROM w),
    n AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles FROM s), x AS (SELECT doc_id, unnest(shingles) AS x FROM s),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n_shingles + nb.n_shingles - c)),
    both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reached AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT doc_id, b FROM reached JOIN both_ways ON other = a)
    SELECT doc_id, n_shingles, component_id FROM n JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY 1) USING (doc_id)"""
_MTREE = """WITH e AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

# The documents' failed filters as letters; every order of the letters, and what a step finds of them.
_FILTERS = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents), w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
    f AS (SELECT doc_id, part, concat(CASE WHEN len(words) < 50 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END,
        CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS failed FROM w),
    l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
    c AS (SELECT part, failed, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
    x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    s AS (SELECT part, failed, n, good, toxic, filter_order, step, contains(failed, filter_order[step]) AS now, translate(failed, filter_order[1:step - 1], '') = failed AS before, translate(failed, filter_order[1:step], '') = failed AS after
        FROM c, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step))
    SELECT part, filter_order, step, CAST(sum(CASE WHEN after THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN before AND now THEN n ELSE 0 END) AS BIGINT) AS removed,
        CAST(sum(CASE WHEN NOT before AND now THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN now AND len(failed) = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
        CAST(sum(CASE WHEN before AND now THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN before AND now THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
        CAST(sum(CASE WHEN now THEN n * 120 // len(failed) ELSE 0 END) AS BIGINT) AS shapley FROM s GROUP BY 1, 2, 3"""
_TREAP = r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
    c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), n AS (SELECT doc_id, sum(tf) AS n FROM c GROUP BY 1), g AS (SELECT count(*) AS big_n, sum(n) AS big_l FROM n), df AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
    q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2),
    s AS (SELECT item_id, doc_id, CAST(sum(times * CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * big_n) // big_l))))) AS BIGINT) AS score
        FROM q JOIN df USING (term) JOIN c USING (term) JOIN n USING (doc_id), g GROUP BY 1, 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0) SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20"""


def oracle_sql() -> dict[str, str]:
    found = {"op1_warc": _WARC, "op4_jaccard": _JACCARD, "op5_mtree": _MTREE, "op12_filter_audit": _FILTERS, "op13_treap_search": _TREAP}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
