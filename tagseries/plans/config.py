"""Configuration of the stage plans on the generated ``events`` table.

The five event types play the sensor tags; ``view`` plays the primary flow tag.  The
source's drop threshold of 0.20 gives constant labels on this data, so the plans use
0.98 (FIXTURES.md §3).
"""

from ..operators.labels import HORIZONS

# Tag catalogue and roles on the test tables.
TAGS = ["click", "error", "purchase", "signup", "view"]
LABEL_TAG = "view"
STEP_S = 300
DROP_THRESHOLD = 0.98
TARGET = "upset_12h"
LABEL_COLS = list(HORIZONS)
KEEP_COLS = ["ts", "is_upset", *LABEL_COLS, "baseline_7d"]

# Feature roles (the source's flow / water / speed pairs mapped onto the five tags).
SENSOR_COLS = ["click", "error", "purchase", "signup", "view"]
ROC_COLS = ["view", "click", "purchase"]
SHARE = {"watercut_proxy": ("error", "view")}
IMBALANCE = {"flow_imbalance": ("view", "click")}
RATIO = {"speed_ratio": ("purchase", "signup")}
SPREAD = {"tag_spread": ("click", "error", "purchase")}
WARMUP_UNTIL = "2024-01-02 00:00:00"
# Every flow tag (both sides of the share and the imbalance) and what is built on it is circular.
CIRCULAR_PREFIXES = (*sorted({*SHARE["watercut_proxy"], *IMBALANCE["flow_imbalance"]}),
                     *SHARE, *IMBALANCE, "flow_vs_baseline")

# Time split of the model stage.
TRAIN_END = "2024-01-20 23:59:59"
TEST_START = "2024-01-21 00:00:00"

# Windows and level-shift date used by the audit plans.
SLICE_START = "2024-01-10 00:00:00"
SLICE_END = "2024-01-12 00:00:00"
SHIFT_AT = "2024-01-15 00:00:00"
