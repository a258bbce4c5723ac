from riftline.functions.columns import *  # noqa: F401,F403
from riftline.functions.folds import *  # noqa: F401,F403
