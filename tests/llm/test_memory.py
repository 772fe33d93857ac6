"""What a Python worker holds between stages."""

import ctypes

import numpy as np

from quietwatch.llm import common


def test_a_worker_gives_freed_memory_back():
    def held():
        with open("/proc/self/smaps_rollup") as lines:
            return sum(int(x.split()[1]) for x in lines if x.startswith("Pss_Anon")) / 1024

    if not hasattr(ctypes.CDLL(None), "malloc_trim"):
        return
    # many small blocks, freed but for the last: the C library keeps them
    blocks = [np.zeros(4_000, np.uint8) + 1 for _ in range(40_000)]
    last = blocks[-1]
    del blocks
    before = held()
    common._LAST[0] = ""
    common.working_as("words")
    assert held() < before - 50 and last[0] == 1
