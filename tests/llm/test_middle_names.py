from papyra.llm.names import signature
from tests.llm.test_names import corpus, entities, together  # noqa: F401


def test_all_middle_names_are_kept_in_order():
    known = {"rosa", "karin", "maria", "ana"}
    for name in ("Rosa A. Karin B. Holm", "Holm, Rosa A. Karin B.", "ROSA A KARIN B HOLM"):
        assert signature(name, known) == ("p", "holm", "rosa", "a karin b"), name
    assert signature("Holm RAB", known) == signature("R. A. B. Holm", known) == ("p", "holm", "r", "a b")
    assert signature("Maria Maria Ana Silva", known) == ("p", "silva", "maria", "maria ana")


def test_conflicting_middle_names_stay_apart(spark, corpus):  # noqa: F811
    rows = corpus + [["Rosa A. B. Hollandway"]] * 3 + [["Rosa A. C. Hollandway"]] * 2 + [["Quint, Robert Karin"]] * 5 + [["Quint, Robert Catherine"], ["Quint, Robert K."], ["R. K. Quint"], ["Robert Karin Quint"]]
    rows += [["Lemwick, Rosa Alba"], ["Lemwick, Rosa Ana"], ["Rosa A. Lemwick"], ["Rosa A. Lemwick"]] + [["Morwick, Rosa Albertine"]] * 3 + [["Morwick, Rosa Albretine"], ["Morwick, Rosa A. M."]]
    groups, _ = entities(spark, rows)
    assert not together(groups, "Rosa A. B. Hollandway", "Rosa A. C. Hollandway")
    assert together(groups, "Quint, Robert Karin", "Quint, Robert K.", "R. K. Quint", "Robert Karin Quint") and not together(groups, "Quint, Robert Karin", "Quint, Robert Catherine")
    assert not together(groups, "Lemwick, Rosa Alba", "Lemwick, Rosa Ana") and (together(groups, "Lemwick, Rosa Alba", "Rosa A. Lemwick") or together(groups, "Lemwick, Rosa Ana", "Rosa A. Lemwick"))
    assert together(groups, "Morwick, Rosa Albertine", "Morwick, Rosa Albretine")
