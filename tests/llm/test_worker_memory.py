"""A Python worker holds one operator's state, and between batches only what is in use."""

import gc
import subprocess
import sys
import weakref
from pathlib import Path

from fleetlens.llm.common import drop_states, worker_state

ROOT = Path(__file__).resolve().parents[2]


class State:
    pass


def test_an_earlier_state_goes_before_the_next_is_made():
    first = weakref.ref(worker_state("first", State))
    again = worker_state("first", State) is first()
    assert again

    def second():
        gc.collect()
        return State(), first() is None

    try:
        assert worker_state("second", second)[1]
    finally:
        drop_states()


FREED = """
import re
import pyarrow as pa
from fleetlens.llm.common import slices, text_slices

def held():
    found = re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())
    return int(found[0]) / 1024

def batches():
    texts = ["a text of some words " * 100] * 20_000
    yield pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])

for cut in (lambda: slices(batches()), lambda: text_slices(batches(), 0, 512)):
    before = held()
    rows = sum(len(part.column(0).to_pylist()) for part in cut())
    assert rows == 20_000, rows
    del rows
    parts = cut()
    for part in parts:
        words = [text.split() for text in part.column(0).to_pylist()]
    words = part = None
    print(held() - before)
"""


def test_memory_of_a_batch_is_given_back():
    done = subprocess.run(
        [sys.executable, "-c", FREED], cwd=ROOT, capture_output=True, text=True, timeout=120
    )
    assert done.returncode == 0, done.stderr
    assert all(float(mb) < 30 for mb in done.stdout.split()), done.stdout
