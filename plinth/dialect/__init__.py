from plinth.dialect.parser import parse
from plinth.dialect.translate import Translator

__all__ = ["Translator", "parse"]
