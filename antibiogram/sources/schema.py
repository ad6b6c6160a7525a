"""Schemas of the three tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in columns.items()])


_S, _D, _L, _B, _DATE = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType(), T.DateType()

SAMPLES = _schema(
    dataset_id=_S, sample_id=_S, collection_date=_DATE, region=_S, district=_S, site_type=_S, source_category=_S, source_type=_S,
    food_matrix=_S, environment_matrix=_S, latitude=_D, longitude=_D,
)
AST = _schema(
    dataset_id=_S, sample_id=_S, isolate_id=_S, organism=_S, antibiotic=_S, result=_S, method=_S, guideline=_S, test_date=_DATE,
    mic_value=_D, zone_diameter=_D, auto_interpreted=_B, interpreted_result=_S, interpretation_guideline=_S,
    interpretation_confidence=_S, suspected_mechanism=_S, interpretation_notes=_S,
)
DATASETS = _schema(
    dataset_id=_S, dataset_name=_S, uploaded_by=_S, uploaded_at=_S, rows_samples=_L, rows_tests=_L, country=_S, is_country_main=_B
)
#: Columns that an upload must have, by sheet.
REQUIRED = {
    "samples": ("sample_id", "collection_date", "region", "district", "site_type", "source_category", "source_type", "food_matrix", "environment_matrix", "latitude", "longitude"),
    "ast_results": ("sample_id", "isolate_id", "organism", "antibiotic", "result", "method", "guideline", "test_date", "mic_value", "zone_diameter"),
}
SOURCE_CATEGORIES = ("ENVIRONMENT", "FOOD", "HUMAN", "ANIMAL", "AQUACULTURE")
METHODS = ("DD", "MIC")
GUIDELINES = ("CLSI", "EUCAST")
