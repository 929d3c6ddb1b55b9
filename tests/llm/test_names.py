from collections import defaultdict

import pytest

from papyra.llm.names import same_entity_pairs, signature, spelling_links, tokens

GIVEN = "Andrew Catherine Robert Rosa Theodore Winifred Gregory Karin".split()


@pytest.fixture(scope="module")
def corpus():
    """Enough clean names for the given names to be learned."""
    rows = []
    for i, g in enumerate(GIVEN):
        rows += [[f"{g} Fam{chr(97 + i)}{chr(97 + j)}oxwick"] for j in range(6)]
    return rows


def entities(spark, rows):
    df = spark.createDataFrame([(r, "x", 1) for r in rows], "authors array<string>, name string, n long")
    links = spelling_links(spark, df, "authors")
    out = defaultdict(set)
    for r in links.collect():
        out[r.entity].add(r.name)
    return out, links


def together(groups, *names):
    return any(set(names) <= g for e, g in groups.items() if e)


def test_variants_of_one_person(spark, corpus):
    same = ["Theodore J. Merwickson", "Merwickson, Theodore J.", "T. J. MERWICKSON", "Merwickson TJ", "Teodore J. Merwickson", "Theodore J. Merwicskon", "Ted J. Merwickson", "Theodore Merwickson", "Prof. Theodore J. Merwickson*", "Merwíckson Theodore J.", "Theodore J. Mer-wickson", "theodore j. merwickson, PhD", "T. J. Merwcikson", " Theodore J. Merwickson (1)"]
    groups, _ = entities(spark, corpus + [[same[0]] for _ in range(9)] + [[s] for s in same])
    assert together(groups, *same)


def test_people_of_one_family_stay_apart(spark, corpus):
    rows = corpus + [["Robert Hollandway"]] * 6 + [["Rosa Hollandway"]] * 4 + [["R. Hollandway"], ["Karin B. Hollandway"], ["Karin M. Hollandway"]]
    groups, _ = entities(spark, rows)
    assert not together(groups, "Robert Hollandway", "Rosa Hollandway") and together(groups, "Robert Hollandway", "R. Hollandway")
    assert not together(groups, "Karin B. Hollandway", "Karin M. Hollandway")


def test_collective_authors(spark, corpus):
    same = ["The Blendwick Cell Map Consortium", "Blendwick Cell Map Cons.", "Consortium, Blendwick Cell Map", "BLENDWICK CELL MAP CONSORTIUM", "Blendwick Consortium for Cell Map", "Blendwik Cell Map Consortium", "Cell Map Consortium Blendwick"]
    rows = corpus + [[same[0]]] * 5 + [[s] for s in same] + [["Dorwick Cell Map Study Group"], ["Dorwick Cell Map SG"]]
    groups, _ = entities(spark, rows)
    assert together(groups, *same) and together(groups, "Dorwick Cell Map Study Group", "Dorwick Cell Map SG")
    assert not together(groups, same[0], "Dorwick Cell Map Study Group")


def test_null_empty_and_nobody(spark, corpus):
    groups, links = entities(spark, [None, [], [None, ""], ["et al."], ["Rosa Solo"], ["***"]])
    assert groups[None] == {"", "et al.", "***"} and together(groups, "Rosa Solo")
    assert same_entity_pairs(links).count() == 0


def test_empty_table(spark):
    groups, links = entities(spark, [])
    assert groups == {} and same_entity_pairs(links).count() == 0


def test_pairs_are_ordered_and_counts_are_kept(spark, corpus):
    _, links = entities(spark, [["Rosa Pairwick", "Pairwick, Rosa", "ROSA PAIRWICK"]] * 3 + corpus)
    assert {tuple(r) for r in same_entity_pairs(links).collect() if "airwick" in r[0].lower()} == {("Pairwick, Rosa", "ROSA PAIRWICK"), ("Pairwick, Rosa", "Rosa Pairwick"), ("ROSA PAIRWICK", "Rosa Pairwick")}
    assert {r.n for r in links.where("name like '%airwick%'").collect()} == {3}


def test_signatures():
    known = {"rosa", "karin"}
    for name in ("Rosa M. Holm", "Holm, Rosa M.", "Holm Rosa M.", "ROSA M HOLM", "rosa m. holm"):
        assert signature(name, known) == ("p", "holm", "rosa", "m"), name
    assert signature("R. M. Holm", known) == signature("Holm RM", known) == signature("Holm, R. M.", known) == ("p", "holm", "r", "m")
    assert signature("Rosa van der Holm", known) == ("p", "vanderholm", "rosa", "")
    assert tokens("Dr. Rosa Holm, PhD") == (["Rosa", "Holm"], [])
