import io
import json

import pytest

from skerry.operators import analytics
from skerry.plans import service
from skerry.plans.engine import SearchEngine


@pytest.fixture(scope="module")
def app(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("docs")
    (folder / "a.txt").write_text("Python programming is fun")
    (folder / "b.txt").write_text("Java programming")
    engine = SearchEngine(spark, analytics.QueryLog(spark, str(tmp_path_factory.mktemp("log") / "q")))
    engine.folder = str(folder)
    return engine, service.create_app(engine)


def call(app, method, path, query="", **headers):
    got = {}
    environ = {"REQUEST_METHOD": method, "PATH_INFO": path, "QUERY_STRING": query, "REMOTE_ADDR": headers.pop("client", "1.2.3.4"), "wsgi.input": io.BytesIO()} | headers
    body = b"".join(app(environ, lambda status, fields: got.update(status=int(status.split()[0]), fields=dict(fields))))
    return got["status"], json.loads(body) if body else None, got["fields"]


def test_routes(app, monkeypatch):
    engine, app = app
    monkeypatch.setenv("SKERRY_API_KEYS", "k1,k2")
    assert call(app, "GET", "/health")[:2] == (200, {"status": "ok"})
    assert call(app, "POST", "/index", f"directory={engine.folder}")[0] == 422
    assert call(app, "POST", "/index", f"directory={engine.folder}", HTTP_X_API_KEY="no")[0] == 401
    assert call(app, "POST", "/index", "directory=/nowhere/at/all", HTTP_X_API_KEY="k1")[0] == 404
    status, body, _ = call(app, "POST", "/index", f"directory={engine.folder}", HTTP_X_API_KEY="k1")
    assert (status, body["indexed"], body["document_count"]) == (200, 2, 2)
    status, body, _ = call(app, "GET", "/search", "q=programming&top_k=1", HTTP_X_API_KEY="k1")
    assert (status, body["query"], body["count"], len(body["results"])) == (200, "programming", 1, 1)
    assert call(app, "GET", "/search", "q=java")[1]["results"][0]["title"] == "b"
    assert [call(app, "GET", "/search", q)[0] for q in ("", "q=", "q=x&top_k=101", "q=x&top_k=z")] == [422] * 4
    assert call(app, "GET", "/suggest", "prefix=prog")[1] == {"prefix": "prog", "suggestions": ["programming"]}
    assert call(app, "GET", "/stats")[1]["document_count"] == 2
    assert call(app, "GET", "/history", HTTP_X_API_KEY="k1")[1]["total_queries"] == 1
    found = call(app, "GET", "/analytics", HTTP_X_API_KEY="k2")[1]
    assert found["total_queries"] == 2 and {x["api_key"] for x in found["queries_per_user"]} == {"k1", "anonymous"}
    assert call(app, "GET", "/history")[0] == 422
    assert (call(app, "GET", "/nothing")[0], call(app, "POST", "/stats")[0]) == (404, 405)


def test_limits_origins_and_log(app, caplog):
    engine, app = app
    with caplog.at_level("INFO", logger="skerry.http"):
        for _ in range(60):
            engine._admit("suggest", "9.9.9.9", 60, None)
        assert call(app, "GET", "/suggest", "prefix=a", client="9.9.9.9")[0] == 429
    assert any("GET /suggest -> 429" in r.getMessage() for r in caplog.records)
    fields = call(app, "OPTIONS", "/search", HTTP_ORIGIN="http://localhost:5173")[2]
    assert fields["Access-Control-Allow-Origin"] == "http://localhost:5173" and "POST" in fields["Access-Control-Allow-Methods"]
    assert "Access-Control-Allow-Origin" not in call(app, "GET", "/health", HTTP_ORIGIN="http://else")[2]
