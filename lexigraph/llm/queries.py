"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete, shared_dir
from .common import table
from .exact_dedup import exact_groups
from .line_dedup import dedup_lines
from .mixing import mix, plain_share
from .pieces import round_trip
from .pii import pseudonymised
from .secrets import secret_spans
from .shards import read_shards, training_rounds, write_rounds
from .simhash import near_groups
from .sketches import edited_prints
from .toxicity import toxicity


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir), table(spark, sf_dir, "labels"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_prints(table(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir), with_text=False).drop("kept_text")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    return mix(docs, quality=plain_share(F.col("text")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir), words=4, distance=4)


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences as they are read back from the shards that the query writes."""
    folder = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    atexit.register(delete, spark, folder)
    return read_shards(write_rounds(training_rounds(table(spark, sf_dir)), folder), folder)


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir), key=b"a key for demonstration")


#: DuckDB has no short name for the white space of the contracts.
_WS = r"[\x20\x09-\x0D]"

_OP9 = rf"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '{_WS}', '', 'g') AS bare FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w AS kept, sha256(bare) AS text_sha256
FROM t WINDOW w AS (PARTITION BY bare ORDER BY n DESC, doc_id NULLS LAST)
"""

_OP5 = r"""
WITH t AS (SELECT doc_id, source, text, CASE WHEN length(text) > 0 THEN greatest(0.05::DOUBLE, length(translate(text, '#$%&*!@^|~<>{}[]', ''))::DOUBLE / length(text)) ELSE 0.05::DOUBLE END AS q, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS w FROM t GROUP BY source),
lv AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER b, 0)) / ((SELECT sum(w) FROM s) - coalesce(sum(w) OVER b, 0)) AS level
       FROM s WINDOW b AS (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT arg_min(level, 2 * source_size / w) AS level FROM lv WHERE level * w <= 2 * source_size),
p AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce((SELECT level FROM g) * w, 2.0::DOUBLE * source_size)) AS target FROM s),
k AS (SELECT t.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
      -ln((('0x' || md5(concat_ws('|', '17', coalesce(doc_id::VARCHAR, md5(text)), t.source))[1:13])::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / q AS key
      FROM t JOIN p ON t.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       size * (epochs + (sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) - size + size / 2.0::DOUBLE <= target - epochs * source_size)::INT)::BIGINT AS taken
FROM k
"""

_OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
k AS (SELECT r, doc_id, lines, list_transform(lines, lambda x: translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS keys FROM d),
e AS (SELECT r, doc_id, unnest(lines) AS line, unnest(keys) AS key, generate_subscripts(lines, 1) AS p FROM k),
h AS (SELECT key, count(DISTINCT r) AS n, max(coalesce(doc_id, -9223372036854775808)) AS top FROM e WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3)
SELECT any_value(e.doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE h.top <> coalesce(e.doc_id, -9223372036854775808)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE h.top IS NULL OR h.top = coalesce(e.doc_id, -9223372036854775808)), '')) AS kept_sha256
FROM e LEFT JOIN h USING (key) GROUP BY e.r
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_toxicity": op2_toxicity,
    "op3_fingerprints": op3_fingerprints,
    "op4_line_dedup": op4_line_dedup,
    "op5_mixing": op5_mixing,
    "op6_simhash": op6_simhash,
    "op7_token_shards": op7_token_shards,
    "op8_pieces": op8_pieces,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_pii": op10_pii,
}
ORACLES: dict[str, str] = {"op4_line_dedup": _OP4, "op5_mixing": _OP5, "op9_exact_dedup": _OP9}
