"""helixmill: non-B DNA motif analytics expressed as Spark DataFrame jobs."""

from helixmill.plans.pipelines import analyze
from helixmill.sources.fasta import read_fasta, sequences_from_dict

__all__ = ["analyze", "read_fasta", "sequences_from_dict"]
