"""DataFrame jobs, one module per part of the pipeline."""
