from tests.conftest import *  # noqa: F401,F403
