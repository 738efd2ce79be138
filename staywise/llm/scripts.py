"""Scripts of letters by code point range."""
import unicodedata

import numpy as np

#: First and last code point of the blocks of each script. Letters elsewhere are "other".
RANGES = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
SCRIPTS = ["", *RANGES, "other"]
_tables = {}


def script_table():
    """Script number of each code point, 0 where it is no letter."""
    if "scripts" not in _tables:
        table = np.zeros(0x110000, np.uint8)
        for number, spans in enumerate(RANGES.values(), 1):
            for low, high in spans:
                table[low : high + 1] = number
        listed = table > 0
        for code in np.flatnonzero(listed[:0x30000]).tolist():
            if code < 0x3400 and unicodedata.category(chr(code))[0] not in "LM":
                table[code] = 0
        for code in np.flatnonzero(~listed[:0x20000]).tolist():
            if unicodedata.category(chr(code))[0] == "L":
                table[code] = len(SCRIPTS) - 1
        _tables["scripts"] = table
    return _tables["scripts"]
