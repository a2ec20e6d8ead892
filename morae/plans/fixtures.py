"""Small inputs of our own for the linguistic queries."""

NAMES = ["δε λα", "θε", "ανδ", "δερ", "οφ θε", "λα θε ανδ", "δε", "εν λα εν", "λα, δε"]
STOP = ["θε", "ανδ", "οφ", "το", "α", "δε", "λα", "διε"]
STOP_MARKED = ["θε", "λα", "και", "ανδ", "α"]
IONIC = ["θη", "χώρη", "ἡμέρη", "αρη", "ωερη", "λη"]
LEXICON = [("θατ", "θα^τ", 1), ("ανδ", "α^νδ", 2), ("ιν", "ι^ν", 3), ("ιτ", "ι_τ", 4), ("ας", "α_ς", 5), ("θις", "θι^ς", 6), ("Λα", "Λα_", 7), ("ιν", "ι_ν", 8), ("κακός", "κα^κός", 9), ("φίλος", "φί^λος", 10), ("φύσις", "φύ^σι^ς", 11)]
ALTERNATIVES = [("ιν", 1, "ι^ν", "Dat"), ("ιν", 2, "ι_ν", "Nom"), ("ιν", 3, "ι^ν", "Nom"), ("λα", 1, "λα_", "Acc"), ("ανδ", 1, "α^νδι", "Nom"), ("χώρα", 1, "χώρα_", "Nom")]
PLACES = [("νεανίας", "_3,^5,_6"), ("θάλασσα", "^2"), ("λύω", "_2"), ("ὕλη", "_1,^1"), ("ἀγαθός", "^1,^3"), ("ab", ""), ("ab", "_9")]
COUNTS = [("νεανίας",), ("νεα_νί^α_ς",), ("πολλάκις",), ("κάλλος",), ("παῖδες",), ("παῖς",), ("ὕλῃ",), ("σωτήρα",), ("ἄνθρωπος",), ("μικρός",), ("λύω",), ("χώρα",), ("δῶρα",), ("πράγματα",), ("ἡμῖν",), ("ἀξία",), ("παρ'",), ("ἄν",), ("ὄρνις",), ("θύρα_",), ("ἀνήρ",), ("ἀδικία",)]
DIPHTHONGS = [("χίλι^οι",), ("χίλιοι^",), ("δα^ίμων",), ("δα^ϊμων",), ("δαίμων",), ("ᾳ_δω",), ("αὐ^τός",), ("λόγῳ",)]
NUMERALS = [("αʹ",), ("ιβ'",), ("λόγος",), ("͵α",), ("παρ'",), ("κγ΄",)]
PATHOLOGIES = [("ὰὰ",), ("ὰά",), ("λόγοσ",), ("λόςγος",), ("άέή",), ("ἁἑὁ",), ("λόγος",)]
UNICODE = [("νεᾱνῐ́ᾱς",), ("ᾱ́",), ("λόγος;",), ("τί·",), ("ἀ",), ("ΐ",), ("abc",)]
TAGGED = [
    ("ἄλλα", "ἄλλος", "ADJ", "Case=Nom|Gender=Fem|Number=Sing"), ("ἄλλα", "ἄλλος", "ADJ", "Case=Acc|Gender=Neut|Number=Plur"), ("χώρα", "χώρα", "NOUN", "Case=Nom|Gender=Fem|Number=Sing"),
    ("χώραν", "χώρα", "NOUN", "Case=Acc|Gender=Fem|Number=Sing"), ("χώρας", "χώρα", "NOUN", "Case=Gen|Gender=Fem|Number=Sing"), ("χώρας", "χώρα", "NOUN", "Case=Acc|Gender=Fem|Number=Plur"),
    ("δῶρα", "δῶρον", "NOUN", "Case=Acc|Gender=Neut|Number=Plur"), ("γυναιξίν", "γυνή", "NOUN", "Case=Dat|Gender=Fem|Number=Plur"), ("ποδοῖν", "πούς", "NOUN", "Case=Dat|Gender=Masc|Number=Dual"),
    ("λογικος", "λογικος", "ADJ", "Case=Nom|Gender=Masc|Number=Sing"), ("δίδωμι", "δίδωμι", "VERB", "Mood=Ind|Number=Sing|Tense=Pres|Voice=Act"), ("δείκνυς", "δείκνυμι", "VERB", "Mood=Ind|Number=Sing|Tense=Pres|Voice=Act"),
    ("φίλου", "φίλος", "NOUN", "Case=Gen|Gender=Masc|Number=Sing"), ("φίλοις", "φίλος", "NOUN", "Case=Dat|Gender=Masc|Number=Plur"), ("κακῷ", "κακός", "ADJ", "Case=Dat|Gender=Masc|Number=Sing"),
    ("φύσις", "φύσις", "NOUN", "Case=Nom|Gender=Fem|Number=Sing"), ("Φύσις", "φύσις", "NOUN", "Case=Nom|Gender=Fem|Number=Sing"), ("κακὸς", "κακός", "ADJ", "Case=Nom|Gender=Masc|Number=Sing"), ("x", "", "", ""),
]
PROP = "k"
GENITIVE = "Case=Gen|Gender=Masc|Number=Sing"
LATIN_BOTH = "abgdezhiklmnopcrstufxywABGDEZHIKLMNOPCRSTUFXYW"
GREEK_BOTH = "αβγδεζηικλμνοπξρστυφχψωΑΒΓΔΕΖΗΙΚΛΜΝΟΠΞΡΣΤΥΦΧΨΩ"
TAG_POS = ["NOUN", "ADJ", "VERB", "PROPN", "X"]
TAG_MORPH = ["Case=Gen|Gender=Fem|Number=Sing", "Case=Nom|Gender=Fem|Number=Sing", "Case=Acc|Gender=Fem|Number=Plur", "Case=Dat|Gender=Masc|Number=Sing", "Case=Acc|Gender=Fem,Masc|Number=Sing", "Case=Gen|Gender=Neut|Number=Plur", "Mood=Ind|Number=Sing|Tense=Pres|Voice=Act", "Case=Acc|Gender=Masc|Number=Plur", ""]
# ending, part of speech, morphology, ending of the lemma
ENDINGS = [
    ("", "X", "", ""), ("α", "NOUN", "Case=Nom|Gender=Fem|Number=Sing", "α"), ("αν", "NOUN", "Case=Acc|Gender=Fem|Number=Sing", "α"), ("ας", "NOUN", "Case=Gen|Gender=Fem|Number=Sing", "α"), ("ον", "ADJ", "Case=Acc|Gender=Masc|Number=Sing", "ος"),
    ("ος", "ADJ", "Case=Nom|Gender=Masc|Number=Sing", "ος"), ("ου", "NOUN", "Case=Gen|Gender=Masc|Number=Sing", "ος"), ("ιν", "NOUN", "Case=Dat|Gender=Masc|Number=Plur", "ις"), ("ι", "NOUN", "Case=Dat|Gender=Neut|Number=Sing", "ι"), ("μι", "VERB", "Mood=Ind|Number=Sing|Tense=Pres|Voice=Act", "μι"),
    ("ει", "VERB", "Mood=Sub|Number=Sing|Tense=Pres|Voice=Act", "ω"), ("ὰ", "ADJ", "Case=Nom|Gender=Neut|Number=Plur", "ός"), ("'", "ADP", "", "α"), ("λα", "ADJ", "Case=Nom|Gender=Neut|Number=Plur", "λος"),
]
