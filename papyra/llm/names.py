"""Variant spellings of the names of people and organisations, by a noisy channel."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Collection, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from papyra.llm.appearance import parts
from papyra.operators.skew import heavy_keys, salted_left_join
from papyra.session import Cut, tasks

# English short forms of given names, each line a name and its short forms.
SHORT_FORMS = {
    "agnes": "aggie nessie", "albert": "al bert bertie", "alexander": "alex sasha sandy alec lex xander", "alexandra": "alex sasha sandra lexi", "alfred": "alf fred alfie",
    "amanda": "mandy", "andrew": "andy drew", "anthony": "tony ant", "antonio": "tonio toni", "arthur": "art artie", "barbara": "barb babs barbie bobbie", "benjamin": "ben benny benji",
    "bruno": "bru", "catherine": "kate cathy cath kitty katie cat", "charles": "charlie chuck chas", "charlotte": "lottie charlie", "christina": "chris tina chrissy", "christine": "chris chrissy tina",
    "christopher": "chris kit topher", "clara": "clare", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie debra", "dmitri": "dima mitya", "donald": "don donnie", "dorothy": "dot dottie",
    "edward": "ed eddie ted ned eddy", "eleanor": "ellie nell nora", "elizabeth": "liz beth lizzie betty eliza bess libby betsy lisa", "emil": "emi", "emily": "em emmy", "eugene": "gene", "felix": "fee",
    "frances": "fran frannie francie", "francis": "frank fran", "francisco": "paco pancho", "frederick": "fred freddie freddy fritz rick", "gabriel": "gabe", "gabriela": "gabi gaby gabby", "geoffrey": "geoff jeff",
    "george": "georgie", "gerald": "gerry jerry", "greta": "gretchen", "gregory": "greg gregg", "harold": "harry hal", "helen": "nell nellie", "henrietta": "hettie etta henny", "henry": "harry hank hal",
    "hugo": "hugh", "ignacio": "nacho iggy", "ingrid": "inga inge", "isabella": "bella izzy isa belle isabel", "jacob": "jake", "james": "jim jimmy jamie", "janet": "jan", "jeffrey": "jeff",
    "jennifer": "jen jenny jenn", "jessica": "jess jessie", "joanna": "jo joan joey", "john": "jack johnny jon", "jonathan": "jon jonny nathan", "jose": "pepe", "joseph": "joe joey", "joshua": "josh",
    "judith": "judy", "karin": "kari", "katherine": "kate kathy katie kat", "kenneth": "ken kenny", "kimberly": "kim kimmy", "larissa": "lara", "lawrence": "larry", "lena": "leni", "leonard": "leo len lenny",
    "louis": "lou", "lucinda": "lucy cindy lou", "margaret": "maggie peggy meg marge greta madge", "maria": "mia", "martin": "marty", "matthew": "matt matty", "michael": "mike mick mickey", "mikhail": "misha",
    "mira": "mirka", "natalia": "natasha nata talia nat", "nathaniel": "nate nat", "nicholas": "nick nicky nico", "nikolai": "kolya", "nora": "norrie", "pamela": "pam", "patricia": "pat trish patty tricia patsy",
    "patrick": "pat paddy", "peter": "pete", "petra": "pet", "philip": "phil pip", "raymond": "ray", "rebecca": "becky becca reba", "richard": "rich rick dick ricky", "robert": "bob rob bobby robbie bert",
    "ronald": "ron", "rosa": "rosie", "samantha": "sam", "samuel": "sam sammy", "sandra": "sandy", "sarah": "sally", "sergei": "seryozha", "stephen": "steve", "steven": "steve", "susan": "sue susie",
    "susannah": "sue susie sukie anna suzy", "sven": "svenne", "teresa": "tess terry tessa tracy", "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim", "tomas": "tom tommy", "valentina": "valya",
    "vera": "verochka", "victor": "vic", "victoria": "vicky vic tori vickie", "vincent": "vince vinny vin", "vladimir": "volodya", "walter": "wally walt", "william": "will bill billy willy liam", "winifred": "winnie freda fred win",
    "zachary": "zach",
}
# Titles and degrees; words of collective authors, with short forms; words that collective names may lack.
TITLES = set("dr prof professor mr mrs ms sir dame md phd msc bsc mph dphil mbbs rn esq jr sr ii iii".split())
COLLECTIVE = {
    "collaboration": "collab collaborative collaborators", "consortium": "cons consort consor", "network": "netw net", "group": "grp gp", "study": "stud", "initiative": "init", "project": "proj", "committee": "comm cttee",
    "team": "", "society": "soc", "association": "assoc assn", "institute": "inst", "university": "univ", "laboratory": "lab", "investigators": "invest", "alliance": "", "working": "wkg", "organization": "org organisation", "center": "centre ctr",
}
MINOR = set("the for of and on in a an".split())

FULL_OF_SHORT: dict[str, list[str]] = {}
for _full, _short in SHORT_FORMS.items():
    for _s in _short.split():
        FULL_OF_SHORT.setdefault(_s, []).append(_full)
COLLECTIVE_OF = {s: w for w, short in COLLECTIVE.items() for s in [w, *short.split()]} | {"sg": "study group", "wg": "working group"}
#: A token is a given name if it stands in the given name's place in at least so many spellings, however many there are, and more often than in the family name's.
GIVEN_LEAST = 3
#: Of two given names one error apart, the one that stands there less than this share as often as the other may be an error of it: errors of frequent names recur too.
ERROR_SHARE = 0.02
#: Log likelihoods of the channel: a form equal but for case, marks and order; a middle initial left out; an initial for a given name; a short form; one typing error.
SAME, NO_MIDDLE, INITIAL, SHORT, TYPO = 0.0, math.log(0.3), math.log(0.1), math.log(0.1), math.log(0.02)


def folded(name: str) -> str:
    """The name without accents and invisible differences, its kind of space being one space."""
    s = "".join(parts(c) if ord(c) > 126 else c for c in name)
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def tokens(name: str) -> tuple[list[str], list[str]]:
    """The words before and after the first comma (none: all before), as they are cased, without titles and marks."""
    s = re.sub(r"\([^)]*\)|\[[^\]]*\]|[0-9*†‡§¶#^]+", " ", folded(name))
    s = re.sub(r"(?<=\w)['’`´-]+(?=\w)", "", s)
    halves = [re.findall(r"[^\W_]+", h) for h in s.split(",")]
    alone = sum(t.lower() not in TITLES for h in halves for t in h) < 2  # then capitals like MD can only be initials
    halves = [[t for t in h if t.lower() not in TITLES or alone and t.isupper() and len(t) < 4] for h in halves]
    halves = [h for h in halves if h]
    return (halves[0], [t for h in halves[1:] for t in h]) if halves else ([], [])


def is_collective(words: list[str]) -> bool:
    return any(w.lower() in COLLECTIVE_OF for w in words) and len(words) > 1


def initials(word: str, shouted: bool) -> bool:
    """Whether a word is one or more initials: a single letter, or two or three capitals in a name that isn't all capitals."""
    return len(word) == 1 or word.isupper() and (len(word) <= 3 and not shouted or len(word) == 2 and word.lower() not in FULL_OF_SHORT)


def full_words(names: pd.Series) -> Iterator[tuple[str, str]]:
    """(name, token) of every word of a name that isn't initials, each once, lower case."""
    for name in names:
        before, after = tokens(name)
        shouted = all(w.isupper() for w in before + after)
        yield from ((name, w) for w in dict.fromkeys(w.lower() for w in before + after if not initials(w, shouted)))


def place_counts(names: pd.Series) -> Iterator[tuple[str, int, int]]:
    """(token, in the given name's place, in the family name's) of every name that shows its order."""
    for name in names:
        before, after = tokens(name)
        if is_collective(before + after):
            continue
        shouted = all(w.isupper() for w in before + after)
        full = [w.lower() for w in before if not initials(w, shouted)]
        if after:
            given = [w.lower() for w in after if not initials(w, shouted)]
            yield from ((g, 1, 0) for g in given[:1])
            yield from ((f, 0, 1) for f in full[:1])
        elif len(full) > 1:
            yield full[0], 1, 0
            yield full[-1], 0, 1


def signature(name: str, given_names: Collection[str]) -> tuple[str, str, str, str] | None:
    """(kind, family, given, middle) of a spelling, middle being all middle names and initials in order; kind ``o`` for collective authors, whose family is their longest own word; None if it names nobody."""
    before, after = tokens(name)
    words = [w.lower() for w in before + after]
    if not words or words == ["et", "al"]:
        return None
    if is_collective(words):
        own = sorted(x for w in words if w not in MINOR for x in COLLECTIVE_OF.get(w, w).split())
        plain = [w for w in own if w not in COLLECTIVE] or own
        head = max(plain, key=lambda w: (len(w), w))
        own.remove(head)
        return "o", head, " ".join(own), ""
    shouted = all(w.isupper() for w in before + after)
    known = lambda w: w in given_names

    def split(ws: list[str]) -> tuple[list[str], list[str]]:
        return [w.lower() for w in ws if not initials(w, shouted)], [c for w in ws if initials(w, shouted) for c in w.lower()]

    def in_order(ws: list[str]) -> list[str]:
        return [c for w in ws for c in (w.lower() if initials(w, shouted) else [w.lower()])]

    full, letters = split(before)
    if after:
        family, (given, more) = full or letters, split(after)
        first, middle = (given[0], (letters if full else [])) if given else ((more + letters or [""])[0], (more + letters)[1:])
        if given:
            inner = in_order(after)
            inner.remove(first)
            middle = inner + middle
    elif len(full) < 2:
        family, first, middle = full or letters[-1:], (letters or [""])[0], letters[1:]
    else:
        back = known(full[-1]) and not known(full[0])
        first, rest = (full[-1], full[:-1]) if back else (full[0], full[1:])
        names = [w for w in rest[:-1] if known(w)] if not back else []
        inner = in_order(before)
        inner.remove(first)
        family, middle = [w for w in rest if w not in names], [w for w in inner if len(w) == 1 or w in names]
        if letters and not initials(before[0], shouted) and before[0].lower() == full[0] and len(rest) == 0:
            family = rest
    return "p", "".join(family), first, " ".join(middle)


#: Of two lists of middle names, in SQL: whether no two at one place conflict (equal, initial and name, or an error apart if one is no known given name); whether some are an error apart; whether the first abbreviates the second.
_MIDDLES = "zip_with(split(middle, ' '), split(to_middle, ' '), (x, y) -> {})"
_ERROR = "length(x) > 1 and length(y) > 1 and x != y"
_NEAR = "(levenshtein(x, y) <= 1 or levenshtein(x, y) = 2 and array_sort(split(x, '')) = array_sort(split(y, '')))"
FIT = f"forall({_MIDDLES.format(f"x is null or y is null or x = y or x = left(y, 1) or y = left(x, 1) or (odd or to_odd) and {_ERROR} and {_NEAR}")}, z -> z)"
ERROR = f"exists({_MIDDLES.format(f"x is not null and y is not null and {_ERROR}")}, z -> z)"
SHORTER = f"forall({_MIDDLES.format("x is null or y is not null and (x = y or x = left(y, 1))")}, z -> z)"


def one_less(text: str, lo: int, hi: int) -> set[str]:
    """The text and what is left of it without one of its letters in [lo, hi). Two texts that share one of these are an error apart."""
    return {text, *(text[:i] + text[i + 1 :] for i in range(lo, hi) if text[i] != "|")}


def spelling_links(spark: SparkSession, rows: DataFrame, names: str) -> DataFrame:
    """``name, n, entity``: every spelling of the array column ``names`` with its count and the entity it is attached to.

    Spellings are normalised to a signature (family, given, middle), which takes up case, accents, order, titles and
    marks; which word is the given name is learned from all spellings. Signatures are the candidate canonical forms, and
    their counts over all rows the prior. Each signature looks for the one it is a variant of, among those that share its
    family and given name but for one letter (deletion keys), whose given name it abbreviates (same family, initial or
    short form) or which differ by a middle initial more or less, and is attached to the one with the highest posterior:
    log prior plus the log likelihood of the variation. A typing error or a middle initial is only believed towards the
    more frequent form (ties: the smaller one), an error not between two known given names, unless one is so rare beside
    the other (``ERROR_SHARE``) that it may be an error itself. Middle names are compared place by place: with an initial for
    a name, or fewer of them, a form is a variant of the fuller one; of two with conflicting ones neither is. Attachments are followed to their end by pointer doubling.

    Only distinct spellings and signatures are joined, and a key brings together forms one letter apart, or the few
    initials of a family with its given names, so no group grows to all pairs. Nulls, empty names and ``et al.`` name
    nobody and have a null entity; an empty table gives no rows.
    """
    cut = Cut(spark, "names")
    spelled = cut(rows.select(F.explode(names).alias("name")).where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n")))

    def count_places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame(list(place_counts(pdf["name"])), columns=["token", "g", "f"]).groupby("token", as_index=False).sum()

    def list_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame(list(full_words(pdf["name"])), columns=["name", "token"])

    places = spelled.select("name").mapInPandas(count_places, "token string, g long, f long").groupBy("token").agg(F.sum("g").alias("g"), F.sum("f").alias("f"))
    given_names = places.where((F.col("g") >= GIVEN_LEAST) & (F.col("g") > F.col("f"))).select("token", "g")

    # every spelling gets those of its words that are given names, and how often they are
    words = cut(spelled.select("name").mapInPandas(list_words, "name string, token string"))
    known = salted_left_join(words, given_names, ["token"], F.col("name"), heavy=cut(heavy_keys(words, ["token"]))).where("g is not null")
    known = known.repartition(tasks(spark), "name").groupBy("name").agg(F.collect_list(F.struct("token", "g")).alias("x")).select("name", F.col("x.token").alias("known"), F.col("x.g").alias("times"))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, n, words, times in pdf[["name", "n", "known", "times"]].itertuples(index=False, name=None):
                counts = {} if words is None else dict(zip(words, times))
                kind, family, given, middle = signature(name, counts) or (None, None, None, None)
                out.append((name, n, kind, family, given, middle, counts.get(given, 0), any(len(w) > 1 and w not in counts for w in (middle or "").split())))
            yield pd.DataFrame(out, columns=["name", "n", "kind", "family", "given", "middle", "named", "odd"])

    signed = cut(spelled.repartition(tasks(spark), "name").join(known.hint("merge"), "name", "left").mapInPandas(sign, "name string, n long, kind string, family string, given string, middle string, named long, odd boolean"))
    forms = cut(signed.where("kind is not null").groupBy("kind", "family", "given", "middle").agg(F.sum("n").alias("n"), F.max("named").alias("named"), F.max("odd").alias("odd")).withColumn("id", F.concat_ws("|", "kind", "family", "given", "middle")))

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows (key, ask, offer, how): what a form asks for and what it can be found by."""
        columns = ["key", "id", "n", "middle", "named", "odd", "ask", "how"]

        def near(text: str, how: float) -> list[tuple[str, float]]:
            """The text itself, and its family name with an error besides."""
            lo = text.index("|") + 1
            return [(text, how), *((f"e{key}", how + TYPO) for key in one_less(text, lo, text.index("|", lo)))]

        for pdf in batches:
            out = []
            for kind, family, given, middle, n, named, odd, form in pdf[["kind", "family", "given", "middle", "n", "named", "odd", "id"]].itertuples(index=False, name=None):
                base = (form, n, middle, named, odd)
                short = kind == "p" and len(given) < 2
                text = f"{kind}|{family}|{given}"
                if short:
                    out += ((key, *base, True, how) for key, how in near(f"i{text}", INITIAL))
                    out += ((text, *base, ask, SAME) for ask in (True, False))
                    continue
                if kind == "p":
                    out += ((key, *base, False, how) for key, how in near(f"ip|{family}|{given[0]}", INITIAL))
                    for full in FULL_OF_SHORT.get(given, ()):
                        out += ((key, *base, True, how) for key, how in near(f"sp|{family}|{full}", SHORT))
                    out += ((key, *base, False, how) for key, how in near(f"s{text}", SHORT))
                out += ((key, *base, ask, TYPO) for key in one_less(text, text.index("|") + 1, len(text)) for ask in (True, False))
            yield pd.DataFrame(out, columns=columns)

    found = forms.repartition(tasks(spark), "id").mapInPandas(keys, "key string, id string, n long, middle string, named long, odd boolean, ask boolean, how double").withColumn("key", F.xxhash64("key"))
    found = cut(found)  # made once, for asks and offers
    asks = found.where("ask").select("key", "id", "n", "middle", "named", "odd", "how")
    offers = found.where("not ask").select("key", F.col("id").alias("to"), F.col("n").alias("to_n"), F.col("middle").alias("to_middle"), F.col("named").alias("to_named"), F.col("odd").alias("to_odd"), F.col("how").alias("to_how"))
    met = salted_left_join(asks, offers, ["key"], F.col("id")).where("id != to and how = to_how and (middle = to_middle or middle = '' or to_middle = '' or " + FIT + ")")
    same_name = F.expr("substring_index(id, '|', 3) = substring_index(to, '|', 3)")
    above = F.expr("to_n > n or (to_n = n and to < id)")
    same_given = F.expr("substring_index(substring_index(id, '|', 3), '|', -1) = substring_index(substring_index(to, '|', 3), '|', -1)")
    one_empty = F.expr("middle = '' or to_middle = ''")
    fits = F.when(same_name & (one_empty | F.expr(ERROR)), above).when(same_name, F.expr(SHORTER)).when(F.col("how") == TYPO, above & (same_given | (F.least("named", "to_named") <= F.greatest("named", "to_named") * ERROR_SHARE))).otherwise(True)
    middle_cost = F.when(F.col("middle") == F.col("to_middle"), SAME).when(one_empty | ~F.expr(ERROR), NO_MIDDLE).otherwise(TYPO)
    cost = F.when(same_name, middle_cost).otherwise(F.col("how") + middle_cost)
    best = cut(met.where(fits).groupBy("id").agg(F.max(F.struct((F.log("to_n") + cost).alias("score"), "to_n", "to")).alias("x")).select("id", F.col("x.to").alias("p")))

    # follow attachments: roots point at themselves; on a ring of attachments all take its smallest form
    ends = best.select(F.col("p").alias("id")).join(best, "id", "left_anti").distinct().withColumn("p", F.col("id"))
    state = cut(best.unionByName(ends).withColumn("m", F.least("id", "p")))
    while True:
        ahead = state.select(F.col("id").alias("p"), F.col("p").alias("q"), F.col("m").alias("k"))
        step = cut(state.join(ahead, "p").select("id", F.col("q").alias("p"), F.least("m", "k").alias("m"), ((F.col("p") != F.col("q")) & (F.col("k") < F.col("m"))).alias("moved"), (F.col("p") != F.col("q")).alias("on")))
        cut.drop(state)
        state = step
        if not state.where("on").limit(1).count() or not state.where("moved").limit(1).count():
            break
    rings = state.select(F.col("id").alias("p"), F.col("m").alias("entity"))
    owner = state.join(rings, "p").select("id", "entity")
    whole = signed.withColumn("id", F.when(F.col("kind").isNotNull(), F.concat_ws("|", "kind", "family", "given", "middle")))
    return whole.join(owner, "id", "left").select("name", "n", F.coalesce("entity", "id").alias("entity"))


def same_entity_pairs(links: DataFrame) -> DataFrame:
    """``name_a, name_b`` (a < b): different spellings attached to the same entity."""
    inside = links.where("entity is not null").select("entity", "name")
    a, b = inside.withColumnRenamed("name", "name_a"), inside.withColumnRenamed("name", "name_b")
    return salted_left_join(a, b, ["entity"], F.col("name_a")).where("name_a < name_b").select("name_a", "name_b")
