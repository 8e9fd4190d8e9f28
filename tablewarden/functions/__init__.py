"""Column helpers shared by every operator."""

from .numbers import as_number, digits_for_letters, number_from_words, plain_decimal, truncate_decimals
from .text import casefold_tokens, hit_count, is_blank, strip, tokens, word_count
from .json import args_of, is_json, json_keys, json_root_type, variant_root_type
from .draws import draw, picked

__all__ = [
    "args_of", "as_number", "casefold_tokens", "digits_for_letters", "draw", "hit_count", "is_blank", "is_json",
    "json_keys", "json_root_type", "number_from_words", "picked", "plain_decimal", "strip", "tokens",
    "truncate_decimals", "variant_root_type", "word_count",
]
