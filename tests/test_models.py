"""HTTP clients against a local server."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from corvane.operators.embedding import HashedWords
from corvane.plans.models import CompatibleChat, CompatibleEmbedder, LocalChat, choose_chat, message_text, post_json


@pytest.fixture
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body, self.headers.get("Authorization")))
            if self.path.endswith("/flaky") and len(seen) < 2:
                self.send_response(503)
                self.end_headers()
                return
            replies = {
                "/v1/chat/completions": {"choices": [{"message": {"content": " hello "}}]},
                "/api/chat": {"message": {"content": [{"text": "a"}, "b"]}},
                "/v1/embeddings": {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]},
            }
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(replies.get(self.path, {"ok": True})).encode())

        def log_message(self, *a):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", seen
    http.shutdown()


def test_clients(server):
    url, seen = server
    assert CompatibleChat(url + "/v1", "m", "k")("hi") == "hello" and seen[-1][2] == "Bearer k"
    assert LocalChat(url, "m")("hi") == "ab" and seen[-1][1]["stream"] is False
    assert CompatibleEmbedder(url + "/v1", "m")(["x", "y"]) == [[1.0], [2.0]]


def test_retry(server):
    url, seen = server
    assert post_json(url + "/flaky", {}, pause=0) == {"ok": True} and len(seen) == 2


def test_choice_and_shapes():
    assert isinstance(choose_chat("u", "m", "k"), CompatibleChat) and isinstance(choose_chat("u", "m"), LocalChat)
    assert [message_text(x) for x in (None, " a ", ["a", {"text": "b"}], {"content": "c"}, 5)] == ["", "a", "ab", "c", "5"]


def test_hashed_words():
    a, b = HashedWords(16)(["One two", "one TWO"])
    assert a == b and sum(x * x for x in a) == pytest.approx(1) and HashedWords(4)([""]) == [[0.0] * 4]
