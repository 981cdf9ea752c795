"""The coverage state of an institution, from its documents and its latest discovery."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Outcomes of a discovery.
FOUND = ("inserted", "refreshed", "unchanged_verified", "unchanged_repaired")
GONE = ("marked_removed", "no_pdfs_found", "dead_url", "wrong_content_type", "transient", "permanent_other", "blocked_url", "file_too_large")
WALLED = ("auth_walled_microsoft", "auth_walled_okta", "auth_walled_google")
WAITING = ("discovered", "extraction_pending")


def coverage_status(in_scope: Column, extracted: Column, found: Column, found_status: Column, outcome: Column) -> Column:
    """One of nine states. ``extracted`` and ``found`` are the latest years with an extracted and with any document."""
    has = extracted.isNotNull()
    current = has & (found.isNull() | (extracted >= found))
    failed, waiting = found_status == "failed", found_status.isin(*WAITING)
    behind = failed & has & (found > extracted)
    prior = "latest_found_extract_failed_with_prior_available"
    after_find = F.when(current, "cds_available_current").when(behind, prior).when(failed, "extract_failed").when(waiting, "cds_found_processing")

    def without_source(otherwise: str) -> Column:
        known = found.isNotNull()
        return F.when(has, "cds_available_stale").when(known & failed, "extract_failed").when(known & waiting, "cds_found_processing").otherwise(otherwise)

    unchecked = F.when(current, "cds_available_current").when(waiting & ~has, "cds_found_processing").when(behind, prior).when(failed, "extract_failed")
    return (
        F.when(~in_scope, "out_of_scope")
        .when(outcome.isin(*FOUND), after_find.otherwise("cds_available_current"))
        .when(outcome.isin(*GONE), without_source("no_public_cds_found"))
        .when(outcome.isin(*WALLED), without_source("source_not_automatically_accessible"))
        .otherwise(unchecked.otherwise("not_checked"))
    )
