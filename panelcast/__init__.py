"""Monthly series outlook on Spark: dense panels, lag features, rolled-forward models."""

from panelcast.plans.outlook import Panel, build_panel, publish_outlook, run_outlook

__all__ = ["Panel", "build_panel", "publish_outlook", "run_outlook"]
