from clusterlens.streaming.arrivals import judge_arrivals

__all__ = ["judge_arrivals"]
