import random
import tracemalloc

from sparkloom.llm import toxicity


def test_the_driver_holds_bits_and_only_different_rows_as_numbers():
    deal = random.Random(1)
    universe = sorted(f"w:f{i}" for i in range(400))
    chosen = {(c, k): toxicity.Chosen(deal.sample(universe, n), [i < 20 for i in range(n)]) for c, n in (("low_quality", 64), ("toxic", 384)) for k in range(toxicity.FOLDS + 1)}
    seen = [(sorted(deal.sample(range(400), deal.randrange(40))), deal.randrange(2), deal.randrange(2)) for _ in range(60)]
    rows = [(i % 5, [low, toxic], 1, on) for i in range(6000) for on, low, toxic in [seen[i % 60]]]
    tracemalloc.start()
    toxicity.chained(["low_quality", "toxic"], chosen, universe, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6000 * 386 * 8  # one matrix of numbers for all rows
