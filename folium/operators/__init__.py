"""DataFrame operators: joins, aggregations, ordered folds, rankings, quality, evaluation and ledgers."""
