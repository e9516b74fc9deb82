#: Names that operators use inside; inputs that carry them must do no harm.
CLASHING = ("component", "record", "labels", "node", "root", "words", "conv", "_n", "_id", "_key", "token", "form", "canonical", "split_", "g", "item", "score_", "place", "n_tokens", "ids", "subject", "body")
