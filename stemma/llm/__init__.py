"""Operations of training-data pipelines, one module each; `plans` has their named queries and SQL."""
