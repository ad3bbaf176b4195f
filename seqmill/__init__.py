"""Part of seqmill: Spark jobs for aligned reads and training corpora."""
