"""canvass.sources"""
