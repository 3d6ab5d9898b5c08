"""The jobs as registered queries, and their SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import attribute_volumes, knowledge_index
from quarry.plans.oracle import KEPT, TOKENS, cell, iou, r
from quarry.session import shared_dir
from quarry.sources.views import with_views


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder of this call under the shared one."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def job1_knowledge_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` taken into a new index by two runs; the whole index after the second."""
    at = _folder(spark, "knowledge-index")
    conf = {"documents": f"{sf_dir}/documents.parquet", "output": f"{at}/index", "checkpoint": f"{at}/checkpoint", "id": "doc_id", "text": "text"}
    for _ in range(2):
        knowledge_index.run(spark, conf)
    return knowledge_index.contents(spark, conf)


def job2_attribute_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of the tables turned into volumes by two runs; all painted cells after the second."""
    conf = {"tables": sf_dir, "output": _folder(spark, "attribute-volumes")}
    for _ in range(2):
        attribute_volumes.run(spark, conf)
    cells = attribute_volumes.volumes(spark, conf)
    return cells.withColumn("confidence", F.round(F.col("confidence") + F.lit(1e-9), 4))


QUERIES = {"job1_knowledge_index": job1_knowledge_index, "job2_attribute_volumes": job2_attribute_volumes}

#: Kept detections in the order of suppression, then folded, then painted.
_RANKED = KEPT + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY image, class_id ORDER BY confidence DESC, det_id) AS rk FROM kept)"
_BOX = "{{'det_id': {p}det_id, 'confidence': {p}confidence, 'x1': {p}x1, 'y1': {p}y1, 'x2': {p}x2, 'y2': {p}y2}}"
_FOLD = (
    f"fold AS (SELECT image, class_id, rk, [{_BOX.format(p='')}] AS chosen FROM ranked WHERE rk = 1 UNION ALL "
    f"SELECT x.image, x.class_id, x.rk, CASE WHEN len(list_filter(fold.chosen, lambda k: {iou('k', 'x')} > 0.3)) > 0 THEN fold.chosen ELSE list_append(fold.chosen, {_BOX.format(p='x.')}) END "
    "FROM fold JOIN ranked x ON x.image = fold.image AND x.class_id = fold.class_id AND x.rk = fold.rk + 1), "
    "folded AS (SELECT image, class_id, unnest(arg_max(chosen, rk)) AS k FROM fold GROUP BY image, class_id), "
    "boxes AS (SELECT image, class_id, k.confidence AS confidence, k.x1 AS x1, k.y1 AS y1, k.x2 AS x2, k.y2 AS y2 FROM folded)"
)
_PAINT = (
    f"wide AS (SELECT *, unnest(generate_series({cell('x1', 20)}, greatest({cell('x1', 20)}, {cell('x2', 20)}))) AS x FROM boxes), "
    f"painted AS (SELECT *, unnest(generate_series({cell('y1', 50)}, greatest({cell('y1', 50)}, {cell('y2', 50)}))) AS y FROM wide)"
)

SQL = {
    "job1_knowledge_index": f"WITH t AS (SELECT doc_id, unnest({TOKENS.format(t='text')}) AS term FROM documents WHERE doc_id IS NOT NULL), p AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY doc_id, term) SELECT doc_id, term, n, (sum(n) OVER (PARTITION BY doc_id))::BIGINT AS n_tokens, count(*) OVER (PARTITION BY term) AS df FROM p",
    "job2_attribute_volumes": with_views("det ver", f"WITH RECURSIVE {_RANKED}, {_FOLD}, {_PAINT} SELECT class_id, image, x, y, {r('max(confidence)')} AS confidence FROM painted GROUP BY class_id, image, x, y HAVING max(confidence) > 0"),
}
