import numpy as np
import pytest

from kiln.operators import units as U


def values(text, lang="en"):
    out = set()
    for _, q, _, v, stated, announced in U.observations(text, lang):
        if not (stated or announced):
            continue
        k = U.UNITS[q][stated or announced]
        out.add((q, round(v * k[0] + k[1])))
    return out


@pytest.mark.parametrize(
    "text, lang, want",
    [
        ("Bar AB-123 was finished at 900 °C.", "en", {("temperature", 900)}),
        ("The slab was soaked at 1,223 K before roughing.", "en", {("temperature", 950)}),
        ("Bar was finished at 2012 degrees Fahrenheit.", "en", {("temperature", 1100)}),
        ("Сляб выдержан при 700 до 1065 °C.", "ru", {("temperature", 700), ("temperature", 1065)}),
        ("Plate was cooled at 66.600 °C/h.", "de", {("cooling_rate", 1110)}),
        ("Лист охлаждали со скоростью 33,5 град/с.", "ru", {("cooling_rate", 2010)}),
        ("Plate yielded at 57,700 psi.", "en", {("stress", 398)}),
        ("Предел текучести составил 41,3 кгс/мм2.", "ru", {("stress", 405)}),
        ("Усилие достигло 43 700 кН.", "ru", {("force", 43700)}),
        ("Plate came from a 0.22-inch transfer bar.", "en", {("length", 5588)}),
        ("Grains of 20.2 microns were counted.", "en", {("length", 20)}),
        ("Specimens absorbed 155 ft-lb.", "en", {("energy", 210)}),
        ("Strengths are quoted throughout in ksi. Plate AB-1 yielded at 62.8.", "en", {("stress", 433)}),
        ("| | A-1 | B-2 |\n|---|---|---|\n| Gauge, in | 1.75 | 0.45 |\n\n474", "en", {("length", 44450), ("length", 11430)}),
        ("Bar was finished at 9​00 °C, in trial 5 with 3 * 4 bars [12], see Figure 7.", "en", {("temperature", 900)}),
        ("Temperatures of\n950 deg-\nrees Celsius", "en", {("temperature", 950)}),
        ("", "en", set()),
        (None, None, set()),
    ],
)
def test_values(text, lang, want):
    assert values(text, lang) == want


def test_number_forms():
    assert U.number("1 129", True) == 1129 and U.number("66.600", True) == 66600 and U.number("66.600", False) == 66.6
    assert U.number("0,725", True) == 0.725 and U.number("1,223", False) == 1223 and U.number("23,2", False) == 23.2


def decoded(quantity, values, stated, announced, level, spread=0.1):
    codes = lambda xs: np.array([U._CODE[quantity, x] for x in xs])
    local = U.costs(quantity, np.array(values, float), codes(stated), codes(announced), np.log(level), spread)
    return [list(U.UNITS[quantity])[i] for i in U.viterbi(local)]


def test_viterbi_follows_level_and_statements():
    # A bare number far off the level takes the unit that brings it back; a written unit holds unless nothing else explains the value.
    got = decoded("temperature", [900, 1200, 1650, 905], ["C", None, None, "C"], [None, None, "F", None], 900)
    assert got == ["C", "K", "F", "C"]
    assert decoded("stress", [500, 510, 505, 495], ["MPa", "MPa", "GPa", "MPa"], [None] * 4, 500) == ["MPa"] * 4
    assert decoded("stress", [500, 700, 0.505, 495], ["MPa", "MPa", "GPa", "MPa"], [None] * 4, 500) == ["MPa", "MPa", "GPa", "MPa"]


def test_stretches_chained_equal_one_sequence():
    rnd = np.random.default_rng(4)
    for _ in range(50):
        local = rnd.exponential(2.0, (40, 5))
        cuts = sorted(rnd.choice(np.arange(1, 40), 3, replace=False).tolist())
        parts = np.split(local, cuts)
        path = [x for part, (first, last) in zip(parts, U.chained([U.summed(p) for p in parts])) for x in U.viterbi(part, first, last)]
        price = lambda p: sum(local[i, k] for i, k in enumerate(p)) + U._SWITCH * sum(a != b for a, b in zip(p, p[1:]))
        assert abs(price(path) - price(U.viterbi(local))) < 1e-9


def test_unstated_switches_are_restored(spark):
    """A device logs bare temperatures whose unit switches and stands nowhere: Viterbi restores nine in ten and more."""
    rnd = np.random.default_rng(8)
    back = {"C": lambda c: c, "K": lambda c: c + 273.15, "F": lambda c: c * 9 / 5 + 32}
    rows, want = [], {}
    for i in range(400):
        c = 900 + 40 * np.sin(i / 60) + rnd.normal(0, 12)
        unit = "C" if i < 40 else "CKF"[(i // 45) % 3]
        v = round(float(back[unit](c)), 1)
        key = f"b_c{i:03d}"
        text = f"Bar was finished at {v} °C." if i < 40 else f"Bar was finished at {v} in that trial."
        rows.append((key, "b", "en", i * 2500, text))
        want[key] = unit
    df = spark.createDataFrame(rows, "chunk_id string, book string, lang string, start_pos int, text string")
    got = {r.chunk_id: r for r in U.normalize(df).collect()}
    assert len(got) == 400 and {got[k].evidence for k in want} == {"stated", "level"}
    right = sum(got[k].unit == u for k, u in want.items() if got[k].evidence == "level")
    assert right >= 0.9 * 360
    assert U.found(df).count() <= 40


def test_misprinted_unit_is_overruled(spark):
    rows = [(f"b_c{i:03d}", "b", "en", i * 900, f"Plate yielded at {480 + i} {'GPa' if i == 17 else 'MPa'}.") for i in range(40)]
    df = spark.createDataFrame(rows, "chunk_id string, book string, lang string, start_pos int, text string")
    odd = [r for r in U.normalize(df).collect() if r.written != r.unit]
    assert [(r.chunk_id, r.written, r.unit) for r in odd] == [("b_c017", "GPa", "MPa")]


def test_tables_with_nulls_repeats_and_clashing_columns(spark):
    rows = [("b_c1", "b", "en", 0, "Bar AB-1 was finished at 900 °C.", 1), ("b_c1", "b", "en", 0, "Bar AB-1 was finished at 900 °C.", 2), ("b_c2", None, None, None, "Plate yielded at 500 MPa.", 3), ("b_c3", "b", None, 5, None, 4), ("b_c4", "b", "ru", 9, "", 5)]
    df = spark.createDataFrame(rows, "chunk_id string, book string, lang string, start_pos int, text string, quantity int")
    assert {tuple(r) for r in U.found(df).collect()} == {("b_c1", "temperature", 900), ("b_c2", "stress", 500)}
    assert U.found(df.limit(0)).collect() == []
    long = spark.createDataFrame([("b_c1", "b", "en", 0, "word " * 200_000 + "was finished at 900 °C.")], "chunk_id string, book string, lang string, start_pos int, text string")
    assert U.found(long).count() == 1
