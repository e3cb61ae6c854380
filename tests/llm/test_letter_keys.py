"""Keys of letters only are random strings too; words and numbers are not."""

from __future__ import annotations

import pytest

from tidemark.llm import secret_scan


@pytest.mark.parametrize("run", ["qXvRkpLmTzWsYbNcDhGfJwKt", "zqxjvkwpfhgbtrmdlcyn"])
def test_letter_only_keys_are_random(run):
    assert [k for k, _, _ in secret_scan.find(f"the key {run} is old", secret_scan.default_vocabulary())] == ["random"]


@pytest.mark.parametrize("run", ["internationalization", "number_of_open_files_in_folder", "path/to/some/folder/name", "erlichschheitheitlich", "2024-01-02_2024-03-04_55", "-" * 40, "=" * 25, "_" * 30])
def test_words_and_numbers_are_not(run):
    assert secret_scan.find(f"see {run} there", secret_scan.default_vocabulary()) == []
