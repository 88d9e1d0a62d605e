"""Answers of the engine: whole files in the context."""

import shutil

from corvane.api import Engine


class Echo:
    """Finds everything relevant, and answers with the prompt."""

    def __call__(self, prompt):
        if prompt.startswith("Does"):
            return "relevant: yes\nscore: 1"
        return prompt if prompt.startswith("Answer") else prompt.rpartition(": ")[2].strip()


def test_answers_show_whole_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    long = "The zeppelin manual. " + "filler " * 30_000 + "the end of the long file"
    (folder / "long.txt").write_text(long)
    (folder / "note.txt").write_text("zeppelin note")
    engine = Engine(spark, f"file://{tmp_path}/index", model=Echo())
    engine.index_folder(str(folder))
    answer = engine.ask_question("zeppelin")
    assert {s["source"] for s in answer.sources} == {"long.txt", "note.txt"} and len(long) > 200_000
    assert long in answer.answer and "zeppelin note" in answer.answer
    shutil.rmtree(folder)  # what can't be read any more leaves the chunks
    answer = engine.ask_question("zeppelin")
    assert len(answer.sources) == 2 and "The zeppelin manual." in answer.answer and "the end of the long file" not in answer.answer
