import tracemalloc

import numpy as np

from postings_engine.llm.hashing import U, mix


def test_mix_works_in_two_arrays():
    x = np.arange(1 << 20, dtype=U)
    kept = x.copy()
    tracemalloc.start()
    out = mix(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.1 * x.nbytes and (x == kept).all()
    def plain(v):
        v = (v ^ (v >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        v = (v ^ (v >> 27)) * 0x94D049BB133111EB % 2**64
        return v ^ (v >> 31)
    assert out[:500].tolist() == [plain(v) for v in range(500)] and int(mix(U(7))) == plain(7)
