import pytest


@pytest.fixture(scope="session")
def tokenizers():
    public = pytest.importorskip("public_tokenizers")
    return lambda name: str(public.path(name))
