import random

from papyra.llm.names import spelling_links


def entity_of(spark, names):
    df = spark.createDataFrame([([n],) for n in names], "authors array<string>")
    return {r.name: r.entity for r in spelling_links(spark, df, "authors").collect()}


def test_rare_given_names_among_many_spellings(spark):
    """Given names of three spellings are learned among 12,000, where a share of them would ask for four or more."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(n)).capitalize()
    rows = [f"{rng.choice(('Karin', 'Gregory', 'Winifred'))} {word(5)}" for _ in range(12000)]
    rows += [f"{g} {f}" for g in ("Oluwaseun", "Thandek", "Thandeka") for f in ("Abrikwist", "Bolmquist", "Celdwist")] + ["Abrikwist Oluwaseun"]
    rows += ["Thandeka Morgwist"] * 3 + ["Thandek Morgwist"]
    rows += ["Gregory Morgwist"] * 9 + ["Gregorry Morgwist"] + [f"Gregorry {word(5)}" for _ in range(5)]
    got = entity_of(spark, rows)
    assert got["Abrikwist Oluwaseun"] == got["Oluwaseun Abrikwist"]  # the order is known
    assert got["Thandek Morgwist"] != got["Thandeka Morgwist"]  # two given names, not an error
    assert got["Gregorry Morgwist"] == got["Gregory Morgwist"]  # an error, though a recurring one
