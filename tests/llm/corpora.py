"""Small invented corpora."""

import numpy as np

VOICES = {
    "en": "the of and to in is that for it was with as his on be at by this had not are but from or have an they which".split(),
    "nl": "de het een van en in is dat op te voor met zijn niet aan er ook als bij maar om uit nog naar heeft worden".split(),
    "fr": "le la les de des et un une est que qui dans pour pas sur avec plus par ce il elle nous vous mais".split(),
    "es": "el los las de que y en un una es por con para no se su del al lo como pero sus este entre".split(),
    "xx": "zorg blik vrum krel druk splint grom brak twil snarf".split(),
}


def say(rng, lang, n):
    return " ".join(str(w) for w in rng.choice(VOICES[lang], n))


def corpus(n=200, seed=0):
    """(doc_id, text, lang) over five voices, every third row of the first one."""
    rng = np.random.default_rng(seed)
    langs = list(VOICES)
    out = []
    for i in range(n):
        lang = "en" if i % 3 == 0 else langs[int(rng.integers(len(langs)))]
        out.append((i, say(rng, lang, int(rng.integers(8, 60))), lang))
    return out
