"""Cuts near the beginning and in short files."""

from __future__ import annotations

import numpy as np
import pytest

from spanweave.llm import media


@pytest.mark.parametrize("lengths", [(5, 5), (1, 1), (2, 3, 2), (3, 60), (1, 40), (20, 4)])
def test_early_cuts_and_short_files(lengths):
    samples = np.concatenate([np.full((n, 192), 255 * (k % 2), np.uint8) for k, n in enumerate(lengths)])
    ends = np.cumsum(lengths).tolist()
    assert [c[:2] for c in media.shots(samples, 25.0)] == list(zip([0, *ends], ends, strict=False))


def test_a_small_early_change_shows_beside_still_pictures():
    samples = np.zeros((40, 192), np.uint8)
    samples[4:, :60] = 128
    assert [c[:2] for c in media.shots(samples, 25.0)] == [(0, 4), (4, 40)]
    assert len(media.shots(np.zeros((6, 192), np.uint8), 25.0)) == 1
