"""A small labelled table of invented URLs (1: to block), the training data of the URL filter, and a held-out part.

Hosts are words of a few themes, alone, in pairs or with a number, and for the allowed ones also made-up names. Prefixes,
domains and paths turn alike for both labels, so that only the words tell them apart.
"""

from __future__ import annotations

BLOCK_WORDS = (
    "casino", "poker", "bet", "bets", "betting", "bookie", "jackpot", "slots", "gambling", "roulette", "blackjack", "baccarat", "lottery", "lotto", "wager", "odds", "bonus", "stake", "draft-kings", "spins",
    "pills", "viagra", "cialis", "levitra", "xanax", "tramadol", "drugstore", "rx-meds", "steroids", "diet-pills", "weightloss", "keto", "enlarge",
    "xxx", "porn", "porno", "pornhub", "adult", "escort", "escorts", "sex", "sexy", "cams", "webcam", "nude", "nudes", "hentai", "erotic", "fetish", "milf", "hookup", "dating", "swinger", "strip", "xvideos", "tube8",
    "warez", "torrent", "torrents", "pirate", "piratebay", "crack", "cracked", "keygen", "serials", "nulled", "rapidleech", "cheats", "hacks", "free-download", "streamz",
    "spam", "spammer", "scam", "phishing", "malware", "trojan", "spyware", "clickbait", "click", "clicks", "bait", "popup", "popunder", "banner", "ads", "adserver", "adclick", "doubleclick", "affiliate", "tracker", "tracking", "pixel-track",
    "payday", "loans", "quick-cash", "fast-cash", "forex", "binary-options", "bitcoin-profit", "crypto-win", "ponzi", "mlm", "get-rich", "replica", "rolex-replica", "fake-id", "followers", "buy-likes", "seo-links", "backlinks", "cheap", "free", "win", "prize", "giveaway", "coupon",
)
ALLOW_WORDS = (
    "weather", "library", "history", "museum", "garden", "recipes", "science", "teacher", "village", "weekly", "journal", "academy", "university", "hospital", "city", "citizen", "police", "court", "justice", "charity",
    "council", "parliament", "government", "ministry", "senate", "news", "daily", "times", "herald", "gazette", "guardian", "independent", "observer", "tribune", "chronicle", "school", "college", "institute", "campus", "student", "music", "orchestra", "theatre", "cinema", "festival", "gallery", "opera",
    "sport", "football", "cricket", "tennis", "running", "cycling", "swimming", "hockey", "travel", "railway", "airport", "airline", "harbour", "station", "transport", "traffic", "hotel", "tourism", "forest", "river", "mountain", "island", "valley", "coast", "wildlife", "nature",
    "bakery", "kitchen", "cooking", "coffee", "restaurant", "farm", "market", "grocery", "books", "reading", "poetry", "writer", "publisher", "press", "language", "grammar", "dictionary", "encyclopedia", "wikipedia", "maths", "physics", "chemistry", "biology", "geology", "astronomy", "medicine", "nursing", "dentist", "clinic", "health", "law", "lawyer",
    "energy", "solar", "electric", "climate", "ocean", "planet", "photo", "camera", "design", "architecture", "craft", "knitting", "woodwork", "software", "developer", "code", "python", "linux", "github", "database", "data", "network", "cloud", "server", "maps", "post", "radio", "television", "review", "magazine", "archive", "research", "society", "association", "foundation", "union", "church", "parish", "family", "children", "parents", "house", "homes", "estate", "bank", "insurance", "finance", "economy", "business", "company", "engineering", "construction", "plumbing", "furniture", "clothing", "shoes", "fashion", "essex", "sussex", "freedom", "liberty", "better", "windows", "winter", "window", "alphabet", "adventure", "address", "admin", "advice", "skiing", "sexton",
    "stadt", "verein", "zeitung", "schule", "universitaet", "gemeinde", "kirche", "garten", "wetter", "reisen", "bergen", "haus", "spiegel", "mairie", "musique", "journaux", "ecole", "jardin", "cuisine", "voyage", "region", "escuela", "noticias", "ciudad", "cocina", "viaje", "salud", "trabajo", "tiempo",
)
PREFIXES = ("", "www.", "m.", "blog.", "shop.", "")
DOMAINS = ("com", "net", "org", "de", "fr", "es", "io", "co.uk", "example.com", "example.net", "example.org")
PATHS = ("/", "", "/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}?page=2", "/index.html", "/{}/05/a-long-title-of-words", "/wiki/Page_{}", "/articles/{}", "/item?id={}", "/en/{}#top", "/search?q=all")
ONSETS, VOWELS = "b c d f g h j k l m n p r s t th tr v w z st".split(), "a e i o u ea io ou".split()


class _Turns:
    def __init__(self, seed: int):
        self.state = seed

    def one(self, of):
        self.state = (self.state * 1103515245 + 12345) % 2147483648
        return of[(self.state >> 8) % len(of)]


def _host(turn: _Turns, words: tuple[str, ...], made_up: bool) -> str:
    name = lambda: "".join(turn.one(ONSETS) + turn.one(VOWELS) for _ in range(turn.one((2, 3, 4)))) + turn.one(("", "n", "s", "r", "ng", "t"))
    if made_up and turn.one((0, 1, 1)):
        return name() if turn.one((0, 0, 1)) else name() + turn.one(("-", "")) + turn.one(words)
    kind, a, b = turn.one((0, 1, 1, 2, 2, 3, 4)), turn.one(words), turn.one(words)
    return (a, a + "-" + b, a + b, a + turn.one(("24", "365", "1", "now", "online", "hub")), "the-" + a)[kind]


def words_of(host: str) -> str:
    """The first listed word that a host holds, of the longest; the host itself if there is none."""
    found = [w for w in BLOCK_WORDS + ALLOW_WORDS if w in host]
    return max(found, key=len) if found else host


def labelled_urls(seed: int = 20, block: int = 800, allow: int = 1200, block_words: tuple[str, ...] = BLOCK_WORDS, allow_words: tuple[str, ...] = ALLOW_WORDS) -> list[tuple[str, int]]:
    """URLs of both labels in turn. The seed fixes them; other words give a held-out table of words that training has not seen."""
    turn, out = _Turns(seed), []
    labels = [int(k * block // (block + allow) != (k + 1) * block // (block + allow)) for k in range(block + allow)]
    for y in labels:
        host = _host(turn, block_words if y else allow_words, not y)
        url = turn.one(("http", "https")) + "://" + turn.one(PREFIXES) + host + "." + turn.one(DOMAINS)
        out.append((url + turn.one(PATHS).format(turn.one(range(2, 3000))), y))
    return out
