from .batches import StreamBatches
from .stages import StreamStage
from .steps import Step, StepRunner
from .windows import StreamWindows

__all__ = ["Step", "StepRunner", "StreamBatches", "StreamStage", "StreamWindows"]
