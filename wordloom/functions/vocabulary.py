"""Markers of correction, function words and equivalents. Results depend on each entry.

Words are normal forms (lower case, no accents); markers are regular expressions on normal text.
"""

from __future__ import annotations

STRONG_MARKERS = (
    r"je (?:re)?recommence", r"on recommence", r"je refais", r"je la refais", r"je le refais", r"je reprends", r"je reformule",
    r"je me reprends", r"je me suis trompee?", r"je me trompe", r"c'?est pas (?:ca|bon|clair)", r"ce n'?est pas ca", r"non pas ca",
    r"non c'?est pas ca", r"je vais pas dire ca", r"je ne vais pas dire ca", r"je voulais dire", r"je recommence la phrase", r"on la refait",
    r"attends? je (?:recommence|refais|reprends|reformule)", r"pardon je (?:recommence|refais|reprends)", r"merde je (?:recommence|refais)",
    r"coupe (?:ca|la)", r"on coupe", r"je coupe", r"je recadre", r"zero je refais",
    r"l(?:et)?\s*me (?:start|try) (?:over|again)", r"let'?s (?:start|try) (?:over|again)", r"start(?:ing)? over", r"take (?:two|2|three|3|it) again",
    r"i'?ll (?:redo|say) that again", r"i mean(?:t)? to say", r"scratch that", r"cut that", r"that'?s not (?:it|right|what i meant)",
    r"i messed (?:that )?up", r"let me rephrase", r"redo",
)

STANDALONE_MARKERS = (
    "non", "nan", "non non", "non non non", "attends", "attend", "attendez", "pardon", "zut", "mince", "merde", "putain",
    "c'est pas ca", "pas ca", "non pas ca", "bref", "enfin", "no", "nope", "wait", "sorry", "hold on", "scratch that",
    "cut", "cut that", "again", "one more time", "encore une fois", "on refait", "je recommence", "je refais",
)

DANGLING = (
    "et ou mais donc car que qui quoi dont parce puisque comme si quand lorsque pour par dans sur sous avec sans chez "
    "vers de du des la le les un une au aux a en ce cet cette ces mon ma mes son sa ses notre nos leur leurs plus "
    "tres trop assez plutot vraiment tellement etait etaient est sont ete avait avaient "
    "j'ai c'est il elle ils elles on nous vous je tu d'un d'une l' qu' "
    "and or but so because that which who the an of to in at for with without was were is are been had have "
    "i he she they we you it my his her their our very really quite rather"
).split()

STOPWORDS = (
    "le la les un une des du de d' l' et ou mais donc or ni car que qui quoi dont ce cet cette ces se sa son "
    "ses mon ma mes ton ta tes notre nos votre vos leur leurs je j' tu il elle on nous vous ils elles me te lui y "
    "en au aux a dans sur sous pour par avec sans chez vers entre est sont etait etaient ete etre ai as avons avez ont "
    "eu eue eus aura auront serai sera seront avait avaient avoir fait faire plus moins "
    "pas ne n' si comme tout tous toute toutes meme aussi alors bien tres deja "
    "encore quand comment pourquoi oui non c'est cela ca la-bas ici "
    "the an and but so of to in at for with without by from is are was were be been being have has "
    "had do does did i you he she it we they him her them my your his our "
    "their this that these those not no yes very just also then than there here what "
    "when why how all some any more most"
).split()

IDEA_SHIFTS = (
    "mais donc alors ensuite apres finalement bref cependant pourtant neanmoins resultat "
    "conclusion premierement deuxiemement troisiemement d'abord enfin surtout attention franchement "
    "honnetement clairement evidemment concretement voila maintenant aujourd'hui imaginez regardez "
    "ecoutez sauf sinon parce puisque grace "
    "but so then next finally however although anyway result first second third "
    "especially honestly clearly obviously actually now today imagine look listen except "
    "otherwise because since meanwhile suddenly"
).split()

EMPHASIS = (
    "incroyable enorme fou folle dingue excellent excellents excellente parfait meilleur meilleure "
    "pire jamais toujours enfin enormement vraiment carrement grave redoutable impressionnant record "
    "historique important essentiel cle crucial attention surtout extremement absolument "
    "totalement completement premiere unique seul "
    "incredible insane crazy huge massive amazing perfect best worst never always really "
    "absolutely totally completely extremely key essential only first historic unbelievable wild"
).split()

CANNOT_START = "que qui dont donc car ni or ou et mais d'un d'une qu' l' y en that which whom nor and but".split()

COMPARISON_FILLERS = (
    "euh euhh heu heuh hum humm hmm hm mmh bah ben beh bon voila quoi genre disons uh uhm um er erm like well basically"
).split()

FILLER_SEQUENCES = ("du coup", "en fait", "je pense que", "je veux dire", "si tu veux", "tu vois", "on va dire", "i mean", "you know")

ORAL_EQUIVALENTS = {
    "pas mal de": "quelques",
    "pas mal": "quelques",
    "un certain nombre de": "quelques",
    "plus precisement": "plutot",
    "plus exactement": "plutot",
    "c est a dire": "plutot",
    "lorsque": "quand",
    "lorsqu": "quand",
    "des que": "quand",
}

INFLECTIONS = (
    "eraient erions assent aient erait erons eront ement ations ation aires ables ances ences "
    "ions iez ais ait ant ent ons ez er ir es s x e"
).split()
