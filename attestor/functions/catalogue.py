"""Ready-made searches for clauses that are often asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Id | name | category | queries
CLAUSES = """
indemnification | Indemnification | Risk Allocation | indemnification hold harmless defend; indemnify and hold harmless against any and all claims losses; shall indemnify defend and hold harmless
limitation_of_liability | Limitation of Liability | Risk Allocation | limitation of liability shall not exceed; in no event shall liability exceed aggregate; consequential incidental special punitive damages
termination | Termination | Term & Termination | termination for cause breach material default; termination for convenience upon written notice; right to terminate this agreement
force_majeure | Force Majeure | Risk Allocation | force majeure act of god natural disaster pandemic; excused from performance beyond reasonable control
confidentiality | Confidentiality / NDA | Information Protection | confidential information shall not disclose; non-disclosure proprietary information trade secret; confidentiality obligations survive termination
governing_law | Governing Law & Jurisdiction | Dispute Resolution | governing law construed in accordance with laws of the state; exclusive jurisdiction venue courts; dispute resolution arbitration mediation
intellectual_property | Intellectual Property | IP & Ownership | intellectual property rights ownership assignment; license grant exclusive non-exclusive royalty; work made for hire copyright patent trademark
representations_warranties | Representations & Warranties | Assurances | represents and warrants authority to enter; representations warranties covenants; to the best of knowledge no material adverse
assignment | Assignment & Delegation | General Provisions | shall not assign without prior written consent; assignment transfer delegation binding upon successors
notices | Notices | General Provisions | notices shall be in writing delivered to; notice deemed given upon receipt certified mail
non_compete | Non-Compete / Non-Solicitation | Restrictive Covenants | non-compete restrictive covenant shall not engage; non-solicitation shall not solicit employees clients
payment_terms | Payment Terms | Financial | payment terms net days invoice due upon receipt; late payment interest penalty past due
"""


def clause_catalogue(spark: SparkSession) -> DataFrame:
    """(id, name, category, queries) of the ready-made searches."""
    rows = [[c.strip() for c in line.split("|")] for line in CLAUSES.strip().split("\n")]
    return spark.createDataFrame([(a, b, c, q.split("; ")) for a, b, c, q in rows], "id string, name string, category string, queries array<string>")


def clause_queries(spark: SparkSession, clause_id: str) -> DataFrame:
    """(query_idx, query) of one clause; no rows for an unknown id."""
    return clause_catalogue(spark).where(F.col("id") == clause_id).select(F.posexplode("queries").alias("query_idx", "query"))
