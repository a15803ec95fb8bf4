"""The sketch and the paths together keep the recall that is aimed at."""

from math import ceil, comb

import pytest

from tessella.llm import jaccard


@pytest.mark.parametrize("threshold, recall", [(0.8, jaccard.RECALL), (0.7, jaccard.RECALL), (0.9, 0.9999)])
def test_recall_of_a_pair_at_the_threshold(threshold, recall):
    need = ceil((threshold - jaccard.slack(threshold)) * jaccard.TOKENS) if recall == jaccard.RECALL else ceil((threshold - jaccard.slack(threshold, recall)) * jaccard.TOKENS)
    p = threshold + (1 - threshold) / 256
    sketch = sum(comb(jaccard.TOKENS, k) * p**k * (1 - p) ** (jaccard.TOKENS - k) for k in range(need))
    missed = 0.0
    for _ in range(jaccard.DEPTH):
        missed = (1 - threshold * (1 - missed)) ** jaccard.BRANCH
    paths = (1 - threshold * (1 - missed)) ** jaccard.runs_for(threshold, recall)
    assert sketch + paths <= 1 - recall
