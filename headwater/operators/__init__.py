"""DataFrame operators: filters, sampling, stripping, chat examples, prediction, evaluation."""
