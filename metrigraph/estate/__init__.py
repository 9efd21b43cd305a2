"""The estate: typed extracts, physical and metric graph, canonical metrics, candidates, scores, programme, ledgers."""
