"""Small frames of tests and samples."""

from __future__ import annotations

import datetime

AST = "dataset_id string, sample_id string, isolate_id string, organism string, antibiotic string, result string, method string, guideline string, test_date date, mic_value double, zone_diameter double"
SAMPLES = "dataset_id string, sample_id string, collection_date date, region string, district string, site_type string, source_category string, source_type string, latitude double, longitude double"


def day(text: str | None):
    return None if text is None else datetime.date.fromisoformat(text)


def tests(spark, rows):
    """Rows of (sample, isolate, organism, antibiotic, result, date)."""
    return spark.createDataFrame([("D", s, i, o, a, r, None, None, day(d), None, None) for s, i, o, a, r, d in rows], AST)


def samples(spark, rows):
    """Rows of (sample, region, district, category, latitude, longitude)."""
    return spark.createDataFrame([("D", s, None, r, d, None, c, None, la, lo) for s, r, d, c, la, lo in rows], SAMPLES)


QUICK_SAMPLES = [
    ("SAM_001", "Ashanti", "Kumasi", "FOOD", 6.6, -1.6),
    ("SAM_002", "Ashanti", "Sekondi", "ENVIRONMENT", 4.9, -1.7),
    ("SAM_003", "Greater Accra", "Accra", "ENVIRONMENT", 5.6, -0.2),
    ("SAM_004", "Central", "Cape Coast", "FOOD", None, None),
]
QUICK_TESTS = [
    ("SAM_001", "ISO_001", "E. coli", "Ampicillin", "R", "2024-01-18"),
    ("SAM_001", "ISO_001", "E. coli", "Ciprofloxacin", "S", "2024-01-18"),
    ("SAM_001", "ISO_002", "E. coli", "Ampicillin", "R", "2024-01-19"),
    ("SAM_001", "ISO_002", "E. coli", "Tetracycline", "R", "2024-01-19"),
    ("SAM_001", "ISO_002", "E. coli", "Gentamicin", "R", "2024-01-19"),
    ("SAM_002", "ISO_003", "Salmonella", "Ampicillin", "I", "2024-01-23"),
    ("SAM_002", "ISO_003", "Salmonella", "Ciprofloxacin", "S", "2024-01-23"),
    ("SAM_003", "ISO_004", "Vibrio", "Tetracycline", "S", "2024-02-08"),
    ("SAM_003", "ISO_004", "Vibrio", "Ampicillin", "S", "2024-02-08"),
    ("SAM_004", "ISO_005", "Staphylococcus", "Methicillin", "R", "2024-02-18"),
]
