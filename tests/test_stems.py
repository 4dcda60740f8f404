"""The English stemmer on words of the published sample vocabulary and on its exception lists."""

from lodestack.functions.stems import EXCEPTIONS, KEPT, english_stem

#: Words and stems of the sample in the stemmer's public description, and examples of its rules.
SAMPLE = """consign consign
consigned consign
consigning consign
consignment consign
consist consist
consisted consist
consistency consist
consistent consist
consistently consist
consisting consist
consists consist
consolation consol
consolations consol
consolatory consolatori
console consol
consoled consol
consoles consol
consolidate consolid
consolidated consolid
consolidating consolid
consoling consol
consolingly consol
consols consol
consonant conson
consort consort
consorted consort
consorting consort
conspicuous conspicu
conspicuously conspicu
conspiracy conspiraci
conspirator conspir
conspirators conspir
conspire conspir
conspired conspir
conspiring conspir
constable constabl
constables constabl
constance constanc
constancy constanc
constant constant
knack knack
knackeries knackeri
knacks knack
knag knag
knave knave
knaves knave
knavish knavish
kneaded knead
kneading knead
knee knee
kneel kneel
kneeled kneel
kneeling kneel
kneels kneel
knees knee
knell knell
knelt knelt
knew knew
knick knick
knif knif
knife knife
knight knight
knightly knight
knights knight
knit knit
knits knit
knitted knit
knitting knit
knives knive
knob knob
knobs knob
knock knock
knocked knock
knocker knocker
knockers knocker
knocking knock
knocks knock
knopp knopp
knot knot
knots knot
caresses caress
ties tie
cries cri
gas gas
this this
gaps gap
kiwis kiwi
luxuriated luxuri
hopped hop
hopping hop
hoped hope
hoping hope
cry cri
by by
say say
generate generat
generates generat
generically generic
generous generous
communism communism
communities communiti
community communiti
arsenal arsenal
arsenic arsenic
agreed agre
feed feed
youth youth
boyish boyish
beautiful beauti
relational relat
vietnamization vietnam
rate rate
roll roll
controlling control
adoption adopt
hypothesis hypothesi
datasets dataset
libraries librari
running run
universities univers
national nation
analogy analog
sensibility sensibl
é é
données donné
x1s x1s""".splitlines()


def test_published_sample(spark):
    pairs = [tuple(line.split()) for line in SAMPLE] + [(w, s) for w, s in EXCEPTIONS.items()] + [(w, w) for w in KEPT] + [(w + "s", w) for w in ("inning", "herring", "earring", "exceed")]
    got = spark.createDataFrame(pairs, "word string, want string").withColumn("got", english_stem("word"))
    assert [tuple(r) for r in got.filter("got <> want").collect()] == []
    assert spark.createDataFrame([(None,), ("",), ("y",), ("yyyy",), ("s",)], "w string").select(english_stem("w")).collect() == [(None,), ("",), ("y",), ("yyyi",), ("s",)]
