"""The dictionary's legend as far as it is evidenced: markers, works, authors. Callers may pass a fuller one."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field


def nfd_text(s: str) -> str:
    return unicodedata.normalize("NFD", s)


@dataclass(frozen=True)
class Legend:
    """Keys are compared in decomposed form; language keys stand without their final dot."""

    version: str = "1"
    languages: dict[str, tuple[str, str | None, str]] = field(default_factory=dict)  # key: language, ISO code, marker
    pos: dict[str, str] = field(default_factory=dict)
    works: dict[str, tuple[str, str]] = field(default_factory=dict)  # key: group, name; keys with blanks match anywhere
    raags: dict[str, str] = field(default_factory=dict)
    bhagats: dict[str, str] = field(default_factory=dict)
    sections: dict[str, str] = field(default_factory=dict)

    def normalised(self) -> Legend:
        keyed = lambda d: {nfd_text(k): v for k, v in d.items()}
        return Legend(self.version, keyed(self.languages), keyed(self.pos), keyed(self.works), keyed(self.raags), keyed(self.bhagats), keyed(self.sections))


# The entries that texts at hand evidence.
EVIDENCED = Legend(
    version="1.1.0",
    languages={
        "ਸੰ": ("Sanskrit", "sa", "ਸੰ."),
        "ਅ਼": ("Arabic", "ar", "ਅ਼."),
        "ਫ਼ਾ": ("Persian", "fa", "ਫ਼ਾ."),
        "ਹਿੰ": ("Hindi", "hi", "ਹਿੰ."),
        "ਸਿੰਧੀ": ("Sindhi", "sd", "ਸਿੰਧੀ."),
        "ਡਿੰਗ": ("Dingal", None, "ਡਿੰਗ."),
    },
    pos={"ਸੰਗ੍ਯਾ": "noun", "ਸੰਗਯਾ": "noun", "ਵਿ": "adjective", "ਸਰਵ": "pronoun", "ਵ੍ਯ": "particle", "ਵਯ": "particle", "ਕ੍ਰਿ": "verb", "ਕ੍ਰਿਯਾ": "verb", "ਧਾ": "verbal_root"},
    works={
        "ਸਹਸ": ("sggs_compositions", "Sahaskriti Salok"),
        "ਸਵਾ": ("sggs_compositions", "Salok Varan te Vadhik"),
        "ਸੁਖਮਨੀ": ("sggs_compositions", "Sukhmani Sahib (Gauri M5)"),
        "ਕ੍ਰਿਸਨਾਵ": ("dasam_granth", "Krishna Avtar"),
        "ਚਰਿਤ੍ਰ": ("dasam_granth", "Charitropakhyan"),
        "ਭਾਗੁ ਕ": ("other_works", "Bhai Gurdas Kabitt"),
    },
    raags={"ਆਸਾ": "Asa", "ਬਿਲਾ": "Bilaval", "ਰਾਮ": "Ramkali", "ਮਾਝ": "Majh", "ਸਾਰ": "Sarang"},
    bhagats={
        "ਕਬੀਰ": "Kabir", "ਫਰੀਦ": "Farid", "ਨਾਮਦੇਵ": "Namdev", "ਰਵਿਦਾਸ": "Ravidas", "ਬੇਣੀ": "Beni", "ਤ੍ਰਿਲੋਚਨ": "Trilochan", "ਧੰਨਾ": "Dhanna", "ਜੈਦੇਵ": "Jaidev", "ਸੈਣ": "Sain",
        "ਪੀਪਾ": "Pipa", "ਸਧਨਾ": "Sadhna", "ਭੀਖਨ": "Bhikhan", "ਸੂਰਦਾਸ": "Surdas", "ਪਰਮਾਨੰਦ": "Parmanand", "ਰਾਮਾਨੰਦ": "Ramanand", "ਮਰਦਾਨਾ": "Mardana", "ਸੱਤਾ ਬਲਵੰਡ": "Satta Balvand", "ਸੁੰਦਰ": "Sundar",
    },
    sections={"ਅਸਟਪਦੀ": "Ashtapadi", "ਛੰਤ": "Chhant", "ਸਲੋਕ": "Salok", "ਸੋਲਹੇ": "Solhe"},
).normalised()
