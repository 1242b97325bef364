"""Word lists. Results depend on each entry; all are lower case without accents."""

from __future__ import annotations

HARD_FILLERS = (
    "euh euhh euuh euuuh heu heuh hum humm hmm hmmm hm mmh mh mmm pff pfff pfiou "
    "uh uhh uhhh uhm um umm ummm er err erm mm mhm"
).split()

SOFT_FILLERS = (
    "bon voila quoi genre disons beh bah baah ben mouais tss ah ahh eh hein oh ohh "
    "like well right okay ok basically huh anyway yeah"
).split()

FILLER_PHRASES = (
    "enfin je veux dire", "enfin bref", "comment dire", "comment dire ca", "je sais pas", "tu vois ce que je veux dire",
    "i mean", "you know", "how do you say", "what was it",
)

INTENSIFIERS = (
    "tres trop super hyper bien vraiment grave beaucoup tellement plein loin long longtemps petit doucement vite encore jamais toujours "
    "non oui si plus moins very so much really way far big small slow fast again never always no yes"
).split()

GRAMMATICAL_DOUBLES = (
    "que qui si ne de a en y l'on on nous vous ils elles lui leur meme tout tous the that to of in it had that's"
).split()

COMMON_SHORT_WORDS = (
    "car par pour sur sous mal bon bien son mon ton ces des les est sont tout tous peu plus moins fin part port mer air point corps cours "
    "court fort long mot main pas gens coup temps rien tres pres vrai "
    "the for one out art man can ran run in on an at as to be so no not and are war win old new own end"
).split()

WEAK_MARKERS = (
    "non", "attends?", "pardon", "enfin", "plutot", "ou plutot", "disons", "bref", "zut", "mince", "merde", "putain", "nan",
    "no", "wait", "sorry", "actually", "rather", "i mean", "nope", "hold on", "anyway",
)
