"""What judging secrets holds at once."""

import tracemalloc

from grovekit.llm import secret_battery


def test_a_null_distribution_is_made_in_pieces(monkeypatch):
    symbols = secret_battery._ALPHABETS[-2][1]
    tracemalloc.start()
    try:
        _, weighed, sums, share = secret_battery.null.__wrapped__(symbols, 256)
        assert tracemalloc.get_traced_memory()[1] < 100e6  # 278 MB in one piece
    finally:
        tracemalloc.stop()
    monkeypatch.setattr(secret_battery, "PIECE", 30_000)
    _, whole, all_sums, all_share = secret_battery.null.__wrapped__(symbols, 256)
    assert (weighed == whole).all() and (sums == all_sums).all() and (share == all_share).all()
