"""What a license template saves as a dictionary."""

from textloom.llm import licenses


def test_a_template_saves_bytes_of_its_own_words_in_any_case_and_layout():
    """The dictionaries had capitals and marks, and texts were compressed in lower case: short templates saved nothing."""
    scanner = licenses.Scanner()
    for i, t in enumerate(licenses.TEMPLATES):
        text = "\n".join(t.text.upper().split())
        assert scanner.saved(scanner.words[i], i) > 0, t.text
        own = [p for p in scanner.places(text.lower()) if p[1] == i]
        assert own and max(p[0] for p in own) == scanner.saved(scanner.words[i], i), t.text
