"""Parameters that the pipeline and the queries of single operators share."""

# Domains told by the label table (the first condition that holds), and their shares of the tokens of the mix.
DOMAINS = {"toxic": "toxic = 1", "good": "quality = 1", "poor": "quality = 0"}
MIX = {"toxic": 0.01, "good": 0.97, "poor": 0.02}
SHARDS = 8
