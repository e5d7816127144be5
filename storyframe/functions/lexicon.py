"""Lexicons as data.  Fixed values."""

from __future__ import annotations

# Effect tags in order of dramatic priority, with Portuguese keywords.
SFX_LEXICON = (
    ("espada", ("espada", "lâmina", "lamina", "aço", "aco", "corta", "corte", "desembainha", "crava", "golpe")),
    ("explosao", ("explosão", "explosao", "explode", "estrondo", "destroça", "destroca", "canhão", "canhao")),
    ("monstro", ("monstro", "criatura", "besta", "ruge", "rugido", "demônio", "demonio", "apóstolo", "apostolo", "mandíbulas", "mandibulas", "garras", "tentáculos", "tentaculos")),
    ("soco", ("soco", "punho", "esmurra", "golpeia", "pancada", "impacto", "atinge")),
    ("fogo", ("fogo", "chamas", "queima", "arde", "fogueira", "incêndio", "incendio")),
    ("grito", ("grita", "grito", "berra", "urra", "uivo")),
    ("trovao", ("trovão", "trovao", "relâmpago", "relampago", "tempestade")),
    ("vento", ("vento", "rajada", "ventania", "sopra")),
    ("passos", ("passos", "caminha", "aproxima")),
    ("porta", ("porta", "portão", "portao")),
)

# The same shape for the driver's invented prose, whose syllables are not Portuguese.
CORPUS_LEXICON = (("sword", ("thston", "erieß", "éauoi")), ("storm", ("ingsh", "lichkeit", "queai")), ("steps", ("onre", "einge", "menta")), ("door", ("stor", "heit", "elle", "asas")))

VOICE_PROFILES = ("homem", "mulher", "idoso", "idosa", "menino", "menina", "criatura")

CUE_WORDS = frozenset((
    "silêncio", "sombra", "sombras", "escuridão", "trevas", "névoa", "vento", "chuva", "noite", "lua", "sangue", "lâmina", "espada", "chamas", "fogo",
    "brilho", "olhar", "olhos", "rosto", "corpo", "corpos", "passos", "grito", "gritos", "ruído", "eco", "cheiro", "ferida", "feridas", "enquanto",
    "lentamente", "subitamente", "súbito", "surge", "surgem", "avança", "avançam", "ergue", "atravessa", "observa", "encara", "aponta", "respira",
    "sussurra", "ecoa", "ecoam", "cai", "caem", "corta", "salta", "recua",
))
CUE_PHRASES = ("de repente", "naquele momento", "nesse instante", "por um instante", "ao longe", "em meio", "diante de", "sem dizer", "ao mesmo tempo", "em silêncio", "a passos", "no meio da")
VERB_ENDINGS = ("ou", "eu", "iu", "ava", "avam", "iam", "ando", "endo", "indo")

# Labels of the audio model, in its order, with the effect tag of each. Fixed values.
AUDIO_LABELS = {
    "sword clash": "espada", "sword slash": "espada", "metal blade": "espada", "explosion": "explosao", "cannon blast": "explosao",
    "punch impact": "soco", "body hit": "soco", "monster roar": "monstro", "animal growl": "monstro", "fire crackling": "fogo",
    "wind blowing": "vento", "human scream": "grito", "footsteps": "passos", "thunder": "trovao", "door creaking": "porta",
    "rain falling": "chuva", "water splash": "agua", "horse galloping": "cavalo", "crowd murmur": "multidao", "bell tolling": "sino",
    "arrow whoosh": "flecha",
}
