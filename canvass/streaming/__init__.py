"""canvass.streaming"""
